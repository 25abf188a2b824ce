"""Importance resampling towards a target: hashed n-gram counts of the corpus and of the target give every document a
weight, and Gumbel noise of a seeded hash turns the highest scores into a draw without replacement.

A batch's texts are joined with sentinels, one regex pass finds all words of the batch, and the documents' offsets,
searched for each n-gram's first and last word, mask the n-grams that would cross a sentinel. What is left is
counted with ``bincount``. An n-gram's bucket is the crc32 of its bytes; crc32 is linear, so that of "a b"
comes from those of a and b by array operations, without building the n-gram.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, buffers, slices, stored

WORDS = rb"[0-9a-z\x80-\xff]+"
SENTINEL = b"\0"
N, BUCKETS, SEED = 3, 10_000, 42
LEAST_WORDS, PERCENT = 20, 5


# --- features -----------------------------------------------------------------------------------------------


def _shift_tables() -> list[np.ndarray]:
    """For j = 0, 1, 2 ...: what 2^j zero bytes after it make of each byte of a crc32 (4 x 256)."""
    one = np.array([[zlib.crc32(b"\0", v << 8 * k) ^ zlib.crc32(b"\0") for v in range(256)] for k in range(4)], np.uint64)
    # crc32 inverts its start value and its result: taken apart, what is left is linear
    tables = [one.astype(np.uint32)]
    for _ in range(31):
        tables.append(_shift(tables[-1], tables[-1].ravel()).reshape(4, 256))
    return tables


def _shift(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_SHIFTS: list[np.ndarray] = []


def followed(crc: np.ndarray, by: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings after each other: of the first, of the second, and the second's length."""
    if not _SHIFTS:
        _SHIFTS.extend(_shift_tables())
    crc = crc.copy()
    for j in range(int(size.max(initial=0)).bit_length()):
        with_bit = np.flatnonzero((size >> j) & 1)
        crc[with_bit] = _shift(_SHIFTS[j], crc[with_bit])
    return crc ^ by


def features(texts: list[bytes], n: int = N, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each n-gram's bucket and text, texts in any order, and each text's number of words."""
    joined = SENTINEL.join(texts).lower()
    found = [m.span() for m in re.finditer(WORDS, joined)]
    start, stop = np.array(found, np.int64).reshape(-1, 2).T
    size = stop - start
    crc = np.fromiter((zlib.crc32(joined[a:b]) for a, b in found), np.uint32, len(found))
    offsets = np.cumsum([0, *(len(t) + len(SENTINEL) for t in texts)])
    owner = np.searchsorted(offsets, start, "right") - 1
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = followed(space, crc, size)
    out, where, gram = [crc % buckets], [owner], crc
    for k in range(1, n):
        gram = followed(gram[:-1], spaced[k:], size[k:] + 1)
        inside = owner[:-k] == owner[k:] if len(owner) > k else np.zeros(len(gram), bool)
        out.append(gram[inside] % buckets)
        where.append(owner[: len(gram)][inside])
    return np.concatenate(out), np.concatenate(where), np.bincount(owner, minlength=len(texts))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows from, to and their texts, of slices of a batch."""
    data, at = buffers(batch.column("text"))
    for i, j in slices(at, SLICE):
        yield i, j, [data[a:b].tobytes() for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist())]


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-grams of all rows' ``text`` by bucket; a task sends each bucket once."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, run in _runs(batch):
                total += np.bincount(features(run, n, buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


# --- the model ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Gains:
    """What each bucket adds to a weight, in thousandths; as many numbers as buckets, at any size of the input."""

    gain: np.ndarray = field(repr=False)
    n: int = N


def fit(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> Gains:
    """Gains of the buckets from whole texts of all rows of both tables: log-ratio of the target's and the corpus's shares,
    each with one more n-gram in every bucket.

    Null texts have no n-gram; with an empty table its shares are even. Rows are counted as often as they occur.
    """

    def dense(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for row in bucket_counts(texts, n, buckets).collect():  # as many rows as buckets at most
            out[row.bucket] = row.n
        return out

    own, wanted = dense(docs), dense(target)
    own_all, wanted_all = float(own.sum() + buckets), float(wanted.sum() + buckets)
    ratio = ((float(t) + 1) * own_all / ((float(s) + 1) * wanted_all) for t, s in zip(wanted.tolist(), own.tolist()))
    return Gains(np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64), n)


def weighed(docs: DataFrame, model: Gains) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of ``docs`` (doc_id, text); other columns are not read."""

    def weigh(batches):
        gain = model.gain
        for batch in batches:
            for i, j, run in _runs(batch):
                bucket, where, words = features(run, model.n, len(gain))
                order = np.argsort(where, kind="stable")
                total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                size = np.bincount(where, minlength=j - i)
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(words), pa.array(size), pa.array(total[ends] - total[ends - size])], ["doc_id", "n_words", "n_features", "weight"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(key: str | Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths of the hash of ``seed:key``; a null key is an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` (a written table) with ``rank``, 1, 2, 3 ... in the given order: sorted in ranges, numbered inside each, and the
    ranges' sizes summed. No range holds all rows, whatever values repeat."""
    spread = F.monotonically_increasing_id()  # rows that tie in all else may part

    def count(batches):
        last = 0
        for batch in batches:
            at = pa.array(np.arange(last + 1, last + len(batch) + 1, dtype=np.int64))
            last += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, at], [*batch.schema.names, "_at"])

    ranged = rows.withColumn("_salt", spread).repartitionByRange(*order, F.col("_salt")).sortWithinPartitions(*order, F.col("_salt"))
    ranged = ranged.drop("_salt").withColumn("_part", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    placed = stored(ranged.mapInArrow(count, f"{fields}, _at long"), "ranked")
    sizes = placed.groupBy("_part").agg(F.max("_at").alias("size"))  # a row for each range
    before = sizes.select(F.col("_part"), (F.sum("size").over(Window.orderBy("_part")) - F.col("size")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def resample(docs: DataFrame, model: Gains, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text; other columns are not read).

    Of the rows with at least ``least`` words, ``percent`` in a hundred, rounded down, are drawn: those with the
    highest scores, ties to the smaller doc_id (nulls last), then to more features. ``rank`` is their place and null for
    all other rows. A row that occurs twice counts twice. Null and empty texts have weight 0 and are never drawn.
    """
    rows = stored(weighed(docs, model).withColumn("score", F.col("weight") + noise("doc_id", seed)), "weighed")
    able = rows.where(F.col("n_words") >= least)
    most = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    ranked = numbered(able, *order).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.unionByName(rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws towards the texts of ``target``, with all their columns.

    Rows of one doc_id are drawn together if one of them is; null ids are one id.
    """
    chosen = resample(docs, fit(docs, target), **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(chosen, F.col("row.doc_id").eqNullSafe(F.col("_drawn")), "left_semi").select("row.*")
