"""Exact substring dedup: every byte covered by a string of ``length`` bytes that starts anywhere else as well goes.

A string's anchor is the least hash of the ``ANCHOR``-byte strings in it (the first, if it occurs again), so equal strings
have equal anchors at the same place. Starts in a row whose strings share one anchor are a segment: each start is in
just one. Segments are dealt by anchor, those whose anchor occurs once are dropped, equal segments are one class, and what
is left of several classes under one anchor goes into shards of whole anchors. A shard's suffix array is built by
induced sorting (``suffixes``); a start repeats if its common prefix with a neighbour in the array is long enough.
Where the classes of one anchor are too many for one array, their strings are dealt once more, each by its own digest.

Equal texts are one text that occurs several times: all of it goes, and other texts are compared with one of its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _powers, buffers, mix, slices, stored, tidy
from .suffixes import repeated

LENGTH, ANCHOR = 400, 128
#: Bytes of a shard's suffix array, and of the classes of one anchor beyond which they are dealt by string.
SHARD, CROWDED = 1 << 20, 4 << 20
#: Bytes whose starts are looked at together, some 100 bytes of arrays for each, and bits of a place among them.
_PIECE, _PLACE = 1 << 18, 22
#: Bytes of texts that are cut out of a batch together.
_TEXTS = 1 << 20


# --- inside a task ------------------------------------------------------------------------------------------


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values: of the ends of blocks and of the beginnings of the next ones."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(data: np.ndarray, at: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text, first start in it, number of starts and anchor's hash of all segments of the texts data[at[i] : at[i + 1]]."""
    for lo, hi in _pieces(at, length):
        piece, ends = data[lo:hi], np.clip(at, lo, hi) - lo
        count = np.maximum(np.diff(ends) - length + 1, 0)
        if not count.sum():
            continue
        up, down = _powers(len(piece))
        with np.errstate(over="ignore"):
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * up, out=total[1:])
            hashes = mix((total[anchor:] - total[:-anchor]) * down[: len(piece) - anchor + 1], 13)
        places = np.arange(len(hashes), dtype=np.uint64)
        low = np.uint64((1 << _PLACE) - 1)
        best = least(hashes & ~low | places, length - anchor + 1) & low
        start = np.repeat(ends[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        best = best[start]
        new = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + 1) | (best[1:] != best[:-1])]))
        text = np.searchsorted(ends[1:], start[new], "right")
        yield text, start[new] + lo - at[text], np.diff(np.append(new, len(start))), hashes[best[new]].view(np.int64)


def _pieces(at: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Bytes from, to of pieces that hold every start of a string once; long texts are taken in several."""
    lo, end = int(at[0]), int(at[-1])
    while lo < end:
        hi = lo + _PIECE
        if hi >= end:
            yield lo, end
            return
        whole = int(at[np.searchsorted(at, hi, "right") - 1])
        if whole > lo:
            yield lo, whole
            lo = whole
        else:
            yield lo, min(hi + length - 1, int(at[np.searchsorted(at, hi, "right")]))
            lo = hi


def _class(data: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _covered(runs: np.ndarray, length: int) -> np.ndarray:
    """Byte ranges (from, to), apart and in order, that the strings starting in runs (first, number) cover."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    stop = np.maximum.accumulate(runs[:, 0] + runs[:, 1] + length - 1)
    new = np.flatnonzero(np.append(True, runs[1:, 0] > stop[:-1]))
    return np.column_stack([runs[new, 0], np.append(stop[new[1:] - 1], stop[-1])])


# --- the operator -------------------------------------------------------------------------------------------


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _named(docs: DataFrame, length: int) -> DataFrame:
    """(name, text): texts long enough to matter, named by 16 bytes of their sha256."""
    return docs.where(F.octet_length("text") >= length).select(F.substring(_digest(F.col("text")), 1, 16).alias("name"), "text")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches (name, text), each name once of a task."""
    seen: set[bytes] = set()
    for batch in batches:
        for i, j in slices(buffers(batch.column("text"))[1], _TEXTS):
            names = batch.column("name").slice(i, j - i).to_pylist()
            new = [i + k for k, x in enumerate(names) if not (x in seen or seen.add(x))]
            if new:
                yield batch.take(pa.array(new, pa.int64()))


def _once_a_task(texts: DataFrame) -> DataFrame:
    """``texts`` (name, text), each once of a task."""
    return texts.mapInArrow(tidy(_once), "name binary, text string")


def _anchored(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(name, start, n, anchor) of the segments of ``texts`` (name, text), each text once of a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _once(batches):  # in the same worker: two would hold the texts twice
            data, at = buffers(batch.column("text"))
            for text, start, n, key in segments(data, at, length, anchor):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("name").take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key)], ["name", "start", "n", "anchor"]
                )

    return texts.mapInArrow(tidy(cut), "name binary, start int, n int, anchor long")


def _with_lists(texts: DataFrame, items: DataFrame, fields: list[str]) -> DataFrame:
    """``texts`` (name, text) that have items, with an array of these; an array is no longer than its text."""
    lists = items.groupBy("name").agg(F.collect_set(F.struct(*fields)).alias("items"))
    return texts.join(lists, "name")


def _list(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each row's number and the fields of its items."""
    column = batch.column("items")
    flat = column.flatten()
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    fields = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
    for r, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
        yield r, {name: x.slice(a, b - a) for name, x in fields.items()}


def _classes(texts: DataFrame, length: int) -> DataFrame:
    """(name, start, n, anchor, class) of the listed segments: a class is 128 bits of a segment's bytes."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for r, x in _list(batch):
                text = data[at[r] : at[r + 1]]
                start, n = x["start"].to_numpy(), x["n"].to_numpy()
                made = [_class(text[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("name")[r].as_py()] * len(made), pa.binary()), x["start"], x["n"], x["anchor"], pa.array(made, pa.binary())], ["name", "start", "n", "anchor", "class"]
                )

    return texts.mapInArrow(tidy(name), "name binary, start int, n int, anchor long, class binary")


def _bytes(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, class, crowded, data) of the listed segments."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for r, x in _list(batch):
                text, start = data[at[r] : at[r + 1]], x["start"].to_numpy()
                made = [text[a:b].tobytes() for a, b in zip(start.tolist(), (start + x["n"].to_numpy() + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays([x["anchor"], x["class"], x["crowded"], pa.array(made, pa.binary())], ["anchor", "class", "crowded", "data"])

    return texts.mapInArrow(tidy(take), "anchor long, class binary, crowded boolean, data binary")


def _runs_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]])))
    return edge[0::2], np.diff(edge)[0::2]


def _in_shards(pieces: DataFrame, length: int, shard: int) -> DataFrame:
    """(class, first, n): runs of starts of a class that start elsewhere, by suffix arrays of whole anchors.

    ``pieces`` (anchor, class, data) are dealt and sorted by anchor; no anchor has more than ``CROWDED`` bytes.
    """

    def marks(held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        rows = [(name, a, n) for (name, _), found in zip(held, repeated([x for _, x in held], length)) for a, n in zip(*(x.tolist() for x in _runs_of(found)))]
        name, first, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["class", "first", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for anchor, name, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "class", "data"))):
                if size >= shard and anchor != last:
                    yield marks(held)
                    held, size = [], 0
                held.append((name, data))
                size, last = size + len(data), anchor
        if held:
            yield marks(held)

    dealt = pieces.select("anchor", "class", "data").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(tidy(sort), "class binary, first int, n int")


def _by_string(pieces: DataFrame, length: int) -> DataFrame:
    """(class, first, n) as of ``_in_shards``, of anchors with too many classes: each string by its 128-bit digest."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("class").to_pylist(), batch.column("data").to_pylist()):
                n = len(data) - length + 1
                made = [_class(data[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(made, pa.binary())], ["class", "first", "string"])

    rows = stored(pieces.select("class", "data").mapInArrow(tidy(digests), "class binary, first int, string binary"), "strings")
    several = rows.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").select("string")
    return rows.join(several, "string", "left_semi").select("class", "first", F.lit(1).alias("n"))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text; other columns are not read).

    Texts are UTF-8 bytes, null an empty one. A byte goes if a string of ``length`` bytes that covers it starts anywhere
    else, in this text (overlaps count) or in another row's; a row that occurs twice has all its strings twice.
    ``n_spans`` counts maximal removed runs and the digest is that of the remaining bytes. Ids may repeat or be null.
    """
    every, removed = _judged(docs.select("doc_id", "text"), length, anchor, shard, crowded)
    gone = removed.select("name", "n_removed", "n_spans", "kept_sha256")
    whole = F.col("often") & (F.col("n_bytes") >= length)
    return every.join(gone, "name", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def _judged(docs: DataFrame, length: int, anchor: int, shard: int, crowded: int) -> tuple[DataFrame, DataFrame]:
    """Every row with digest, name, n_bytes and whether its text occurs in several rows; and what changes of texts that
    occur once: name, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    name = F.substring("digest", 1, 16).alias("name")
    narrow = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), _digest(F.col("text")).alias("digest"))
    rows = stored(narrow.select("*", name), "rows")
    often = rows.groupBy("name").agg(F.count("*").alias("times")).where("times > 1").select("name", F.lit(True).alias("often"))
    every = rows.join(often, "name", "left").withColumn("often", F.coalesce("often", F.lit(False)))

    named = _named(docs.select("text"), length)
    cut = stored(_anchored(named, length, anchor), "segments")
    several = cut.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    listed = _with_lists(_once_a_task(named), cut.join(several, "anchor", "left_semi"), ["start", "n", "anchor"])
    texts = stored(listed.dropDuplicates(["name"]), "texts")

    placed = stored(_classes(texts, length), "classes")
    classes = placed.groupBy("anchor", "class").agg(F.count("*").alias("times"), F.min(F.struct("name", "start", "n")).alias("at"))
    classes = stored(classes.select("anchor", "class", "times", "at.*"), "class_sizes")
    shared = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.sum(F.col("n") + (length - 1)).alias("bytes")).where("classes > 1")
    shared = shared.select("anchor", (F.col("bytes") > crowded).alias("crowded"))
    pieces = stored(_bytes(_with_lists(texts.select("name", "text"), classes.join(shared, "anchor"), ["start", "n", "anchor", "class", "crowded"]), length), "pieces")
    found = _in_shards(pieces.where("NOT crowded"), length, shard).union(_by_string(pieces.where("crowded"), length))
    # a class that occurs several times repeats as a whole; of the others, what starts in another class or place
    marks = found.union(classes.where("times > 1").select("class", F.lit(0).alias("first"), "n")).select(F.col("class").alias("_class"), "first", F.col("n").alias("m"))
    runs = placed.join(marks, placed["class"] == marks["_class"]).select("name", (F.col("start") + F.col("first")).alias("start"), F.col("m").alias("n"))
    once = runs.join(often, "name", "left_anti")  # of texts that occur in several rows nothing stays
    return every, _with_lists(texts.select("name", "text"), once, ["start", "n"]).mapInArrow(tidy(_remove(length)), "name binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _remove(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, j - i) for whole in batches for i, j in slices(buffers(whole.column("text"))[1], _TEXTS)):
            data, at = buffers(batch.column("text"))
            rows = []
            for r, x in _list(batch):
                text = data[at[r] : at[r + 1]].tobytes()
                spans = _covered(np.column_stack([x["start"].to_numpy(), x["n"].to_numpy()]).astype(np.int64), length)
                kept = b"".join(text[a:b] for a, b in zip([0, *spans[:, 1].tolist()], [*spans[:, 0].tolist(), len(text)]))
                rows.append((batch.column("name")[r].as_py(), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            name, gone, spans, digest, kept = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(name, pa.binary()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                ["name", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return remove


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """``docs`` with the bytes that stay of each text as ``kept`` (null text: empty); all rows and columns stay.

    A cut may fall inside a character, so what stays is bytes. ``docs`` has no column ``kept``.
    """
    every, removed = _judged(docs.select("doc_id", "text"), length, anchor, shard, crowded)
    often = every.where(F.col("often") & (F.col("n_bytes") >= length)).select(F.col("name").alias("_name"), F.lit(b"").alias("_kept"))
    changed = removed.select(F.col("name").alias("_name"), F.col("kept").alias("_kept")).union(often.distinct())
    rows = docs.select(F.struct("*").alias("row"), F.substring(_digest(F.col("text")), 1, 16).alias("_own"))
    kept = F.coalesce("_kept", F.coalesce("row.text", F.lit("")).cast("binary")).alias("kept")
    return rows.join(changed, F.col("_own") == F.col("_name"), "left").select("row.*", kept)
