"""Token ids in files of entropy-coded blocks: a static range asymmetric numeral system (rANS).

A file set is a folder with two Parquet tables, so that writing is committed as a whole and any store Spark
knows can hold it:

* ``blocks``: ``part, block, n_docs, n_tokens, data``. ``data`` is one block in the binary format below;
* ``table``: the shared frequency table, ``token, freq``; frequencies sum to ``1 << SCALE``.

A block holds whole documents in ascending doc_id order (nulls first; rows of one id in the order of a hash of their ids), at least ``BLOCK_TOKENS`` ids
except the last of its part. Layout, little-endian::

    4s magic "rAN1"   u32 docs   u64 ids   u32 lanes   u32 checkpoints   u32 words   u32 crc32 of what follows
    i64 doc_id[docs]  u8 has_id[docs]  u32 length[docs]
    per checkpoint:   u32 step, u32 word offset, u64 state[lanes]      (the first is step 0)
    u32 word[words]

Id i of a block belongs to lane ``i % lanes`` at step ``i // lanes``. Lanes share one word stream and advance
together, so a step is a handful of array operations. States are 64 bits, renormalised by 32-bit words.
Blocks are independent; inside a block decoding can start at any checkpoint.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SLICE, buffers, shared_folder, slices, stored, tidy, word_table

SCALE = 22
BLOCK_TOKENS = 1 << 18
LANES = 1024
CHECKPOINT_STEPS = 128
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIQIIII")

# --- ids ----------------------------------------------------------------------------------------------------

_WORDS: dict[tuple[str, str], dict] = {}
#: Ids of words that a worker remembers, in all, and the longest word it remembers, in bytes.
REMEMBERED, LONGEST = 12_000_000, 64
#: Words encoded as one text.
RUN = 100


def _of_letters(word: bytes) -> bool:
    """Whether a word is of Latin letters that stay letters, one for one, in lower case."""
    text = word.decode()
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


class Known:
    """Ids of words by the words' hashes: sorted arrays, and the ids one after the other."""

    def __init__(self):
        self.hashes, self.begin, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u2")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes, and which of them are here."""
        at = np.searchsorted(self.hashes, hashes)
        here = np.zeros(len(hashes), bool)
        inner = at < len(self.hashes)
        here[inner] = self.hashes[at[inner]] == hashes[inner]
        return at, here

    def add(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """Sorted hashes that are not here yet, and where in ``flat`` the ids of their words are."""
        at = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, at, len(self.flat) + begin)
        self.size, self.hashes = np.insert(self.size, at, size), np.insert(self.hashes, at, hashes)
        self.flat = np.concatenate([self.flat, flat])


class Encoder:
    """Ids of texts under a tokenizer that treats words between ASCII white space one by one, and a closing mark
    after an ASCII letter or digit as one of its own.

    Such a tokenizer gives a text the ids of its words one after the other. The words of a run of texts are made
    distinct first, by their 64-bit hashes; a worker remembers the ids of words it has seen, by the same hashes and up to a
    bound; new ones are encoded many to a call: words of letters, which are one pre-token each, up to the id that ends a
    pre-token, others with a mark between them that is a pre-token of its own. ``end`` follows every text. Ids are
    below 65,536. Where the tokenizer lower-cases, words that differ in the case of letters A-Z are one.
    """

    MARK = "\x01"

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.known = _WORDS.setdefault((path, "ids"), {0: Known()})
        made = _WORDS.setdefault((path, "tokenizer"), {})
        if not made:
            made[0] = Tokenizer.from_file(path)
        self.tokenizer, self.end = made[0], end
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix and 0 not in _WORDS.setdefault((path, "closes"), {}):
            closes = np.zeros(1 << 16, bool)
            closes[[i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith(suffix)]] = True
            _WORDS[path, "closes"][0] = closes
        self.closes = _WORDS[path, "closes"][0] if suffix else None
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def fresh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word begin in the ids of all, their number, and these ids."""
        mark, size, got = self.MARK.encode(), np.zeros(len(words), np.int64), []
        order: list[int] = []
        letters = [i for i, w in enumerate(words) if self.closes is not None and (w.isalpha() or _of_letters(w))]
        rest = set(range(len(words))).difference(letters)
        runs = [letters[i : i + RUN] for i in range(0, len(letters), RUN)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([b" ".join([words[i] for i in run]).decode() for run in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u2")
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) != len(run) or ends[-1] != len(ids) - 1:
                rest.update(run)
                continue
            order += run
            size[run] = np.diff(ends, prepend=-1)
            got.append(ids)
        alone = [i for i in sorted(rest) if mark in words[i] or len(self.mark) != 1]
        for i in alone:
            got.append(np.array(self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids, "<u2"))
            size[i] = len(got[-1])
        order += alone
        together = sorted(rest.difference(alone))
        runs = [together[i : i + RUN] for i in range(0, len(together), RUN)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([f" {self.MARK} ".join([words[i].decode() for i in run]) for run in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u2")
            marks = ids == self.mark[0]
            size[run] = np.diff(np.flatnonzero(np.append(marks, True)), prepend=-1) - 1
            order += run
            got.append(ids[~marks])
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return begin, size, np.concatenate(got) if got else np.zeros(0, "<u2")

    def one_case(self, data: np.ndarray) -> np.ndarray:
        """``data`` with A-Z in lower case, if no id depends on it: not before a byte beyond ASCII (marks may join one case
        of a letter only), and not at all if a token that is found before lower-casing could be there."""
        raw = data.tobytes() if self.lower else b""
        if not raw or any(t.lower() in raw.lower() for t in self.added):
            return data
        plain = np.ones(len(data), bool)
        plain[:-1] = data[1:] < 128
        return np.where(plain, LOWER[data], data)

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[at[i]:at[i + 1]], one after the other, and the number of each."""
        n = len(at) - 1
        data, at = self.one_case(data[at[0] : at[-1]]), at - at[0]
        hashes, owner, start, stop = word_table(data, at, lower=False, marks_off=True)
        hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        known = self.known[0]
        place, here = known.find(hashes)
        begin, size, flat = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), known.flat
        begin[here], size[here] = known.begin[place[here]], known.size[place[here]]
        new = np.flatnonzero(~here)
        if len(new):
            words = [data[a:b].tobytes() for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist())]
            where, size[new], fresh = self.fresh(words)
            begin[new] = len(flat) + where
            flat = np.concatenate([flat, fresh])
            if len(known.flat) > REMEMBERED:
                known = self.known[0] = Known()
            short = stop[first[new]] - start[first[new]] <= LONGEST
            known.add(hashes[new[short]], where[short], size[new[short]], fresh)
        each = size[which] if len(which) else np.zeros(0, np.int64)
        total = int(each.sum())
        source = np.repeat(begin[which] - (np.cumsum(each) - each), each) + np.arange(total) if total else np.zeros(0, np.int64)
        counts = np.bincount(owner, each, n).astype(np.int64) + 1
        out, ends = np.empty(total + n, "<u2"), np.cumsum(counts) - 1
        inner = np.ones(total + n, bool)
        inner[ends] = False
        out[inner], out[ends] = flat[source], self.end
        return out, counts


def token_ids(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, n, ids): every whole text's ids as little-endian 16-bit numbers with the end id; null text: empty.

    The vocabulary has at most 65,536 ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path, end)
        for batch in batches:
            data, at = buffers(batch.column("text"))
            for i, j in slices(at, SLICE):
                ids, n = encoder(data, at[i : j + 1])
                places = np.concatenate([[0], np.cumsum(2 * n)])
                held = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n), held.cast(pa.binary())], ["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(encode), "doc_id long, n long, ids binary")


# --- the code -----------------------------------------------------------------------------------------------


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to a sum of 1 << scale, at least 1 for each id that occurs."""
    total, room = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts * (room / total)).astype(np.int64), 0)
    while (off := room - int(freq.sum())) != 0:  # the frequent ids take what rounding left
        order = np.argsort(-freq, kind="stable")
        take = order[: max(1, min(abs(off), int((freq > 1).sum())))]
        freq[take] += 1 if off > 0 else -1
    return freq


class Code:
    """Encoding and decoding under one frequency table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)
        self.symbol: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> tuple[int, list[tuple[int, int, np.ndarray]], np.ndarray]:
        """Lanes, checkpoints (step, word offset, states) and words of ids that the table holds."""
        lanes = max(1, min(LANES, len(ids) // 64))
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, _LOW, np.uint64)
        freq, base, saved, words = self.freq[ids], self.base[ids], [], []
        limit = freq << (np.uint64(63) - self.scale)
        for t in range(steps - 1, -1, -1):
            at = slice(t * lanes, min((t + 1) * lanes, len(ids)))
            f, x = freq[at], state[: at.stop - at.start]
            full = x >= limit[at]
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(x)] = (q << self.scale) + (x - q * f) + base[at]
            if t % CHECKPOINT_STEPS == 0:
                saved.append((t, sum(map(len, words)) if t else 0, state.copy()))
        words.reverse()
        every = np.concatenate(words) if words else np.zeros(0, "<u4")
        back = [(t, len(every) - n if t else 0, s) for t, n, s in reversed(saved)]
        return lanes, back, every

    def decode(self, n: int, lanes: int, points: list, words: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``first`` up to checkpoint ``last`` (the end)."""
        if self.symbol is None:
            self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        if not n:
            return np.zeros(0, np.uint32)
        begin, at, state = points[first]
        stop = -(-n // lanes) if last is None or last >= len(points) else points[last][0]
        state, mask = state.copy(), np.uint64((1 << int(self.scale)) - 1)
        out = np.zeros(min(n, stop * lanes) - begin * lanes, np.uint32)
        for t in range(begin, stop):
            m = min(lanes, n - t * lanes)
            x = state[:m]
            slot = x & mask
            s = self.symbol[slot]
            out[(t - begin) * lanes : (t - begin) * lanes + m] = s
            x = self.freq[s] * (x >> self.scale) + slot - self.base[s]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
            state[:m] = x
        return out


def write_block(code: Code, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """One block of (doc_id, ids) in the binary format."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    lanes, points, words = code.encode(ids)
    body = b"".join(
        [
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
            np.array([d is not None for d, _ in docs], np.uint8).tobytes(),
            np.array([len(x) for _, x in docs], "<u4").tobytes(),
            *(struct.pack("<II", t, at) + s.astype("<u8").tobytes() for t, at, s in points),
            words.tobytes(),
        ]
    )
    return _HEAD.pack(b"rAN1", len(docs), len(ids), lanes, len(points), len(words), zlib.crc32(body)) + body


def read_block(code: Code, data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The (doc_id, ids) of a block; a ValueError if its checksum is wrong."""
    magic, docs, n, lanes, points, words, crc = _HEAD.unpack_from(data)
    if magic != b"rAN1" or zlib.crc32(memoryview(data)[_HEAD.size :]) != crc:
        raise ValueError("a damaged block")
    at = _HEAD.size
    names = np.frombuffer(data, "<i8", docs, at)
    known = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at := at + docs)
    at += 4 * docs
    saved = []
    for _ in range(points):
        t, offset = struct.unpack_from("<II", data, at)
        saved.append((t, offset, np.frombuffer(data, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    ids = code.decode(n, lanes, saved, np.frombuffer(data, "<u4", words, at).astype(np.uint64))
    ends = np.cumsum(sizes)
    return [(int(d) if k else None, ids[e - s : e]) for d, k, s, e in zip(names, known, sizes, ends)]


# --- files --------------------------------------------------------------------------------------------------


def _table(freq: DataFrame) -> np.ndarray:
    """The shared table on the driver: at most 65,536 rows."""
    rows = freq.limit(1 << 16).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[rows["token"].to_numpy()] = rows["freq"].to_numpy()
    return out


def write_ids(docs: DataFrame, folder: str, path: str, end: int, parts: int | None = None) -> None:
    """Encode every whole text of (doc_id, text) and write the file set in ascending doc_id order.

    Null text: the end id alone. Rows with equal ids are each written, the longest first. An empty table gives no blocks.
    """
    spark = docs.sparkSession
    ids = stored(token_ids(docs, path, end), "ids")

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                got = np.bincount(np.frombuffer(x.as_buffer(), "<u2"))
                total[: len(got)] += got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["token", "n"])

    sums = ids.select("ids").mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()  # a row per id of the vocabulary at most
    total = np.zeros(1 << 16, np.int64)
    total[rows["token"].to_numpy()] = rows["n"].to_numpy()
    freq = frequencies(total)
    some = np.flatnonzero(freq)
    spark.createDataFrame(
        pa.table({"token": pa.array(some, pa.int64()), "freq": pa.array(freq[some], pa.int64())})
    ).coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)

    def blocks(batches):
        code, part, block = Code(shared.value), None, 0
        waiting, size = [], 0

        def row():
            nonlocal waiting, size, block
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([len(waiting)], pa.int64()), pa.array([size], pa.int64()), pa.array([write_block(code, waiting)], pa.binary())],
                ["part", "block", "n_docs", "n_tokens", "data"],
            )
            waiting, size, block = [], 0, block + 1
            return out

        for batch in batches:
            for part, doc, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                waiting.append((doc, np.frombuffer(x.as_buffer(), "<u2").astype(np.uint32)))
                size += len(waiting[-1][1])
                if size >= BLOCK_TOKENS:
                    yield row()
        if waiting:
            yield row()

    count_of = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id"), F.desc("n"), F.col("tie")]
    ordered = ids.withColumn("tie", F.xxhash64("ids")).repartitionByRange(count_of, *order).sortWithinPartitions(*order)
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(
        tidy(blocks), "part int, block long, n_docs long, n_tokens long, data binary"
    ).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_ids(spark, folder: str, digest) -> DataFrame:
    """(doc_id, start, n_tokens, digest): a row per document of the files.

    ``start`` is the number of ids of all documents before it. ``digest`` maps a document's ids (little-endian
    unsigned 32-bit) to a long; blocks are decoded in parallel.
    """
    table = spark.read.schema("token long, freq long").parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(_table(table))
    blocks = spark.read.schema("part int, block long, n_docs long, n_tokens long, data binary").parquet(f"{folder}/blocks")

    def unpack(batches):
        code = Code(shared.value)
        for batch in batches:
            for part, block, data in zip(*(batch.column(c) for c in ("part", "block", "data"))):
                got = read_block(code, data.as_py())
                sizes = np.array([len(x) for _, x in got], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * len(got), pa.int32()), pa.array([block.as_py()] * len(got), pa.int64()),
                        pa.array([d for d, _ in got], pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
                        pa.array([digest(x.astype("<u4").tobytes()) for _, x in got], pa.int64()),
                    ],
                    ["part", "block", "doc_id", "inside", "n_tokens", "digest"],
                )

    docs = blocks.select("part", "block", "data").mapInArrow(tidy(unpack), "part int, block long, doc_id long, inside long, n_tokens long, digest long")
    sizes = blocks.select("part", "block", "n_tokens")
    # Prefix sums in two steps: of the parts, then of the blocks of each part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part")
    start: Column = F.col("part_start") + F.col("block_start") + F.col("inside")
    return docs.join(starts.select("part", "block", "part_start", "block_start"), ["part", "block"]).select("doc_id", start.alias("start"), "n_tokens", "digest")


def written(docs: DataFrame, path: str, end: int) -> str:
    """Write a file set in the shared folder; its place."""
    folder = f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_ids(docs, folder, path, end)
    return folder
