"""Helpers the operators share: written tables, components, text buffers, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a pattern's class and as bytes.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Bytes of text worked on at a time inside a task.
SLICE = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only for local sessions without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_fold(key: Column | str, of: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``of``; a null id: as of an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key, F.lit("")).cast("binary")) % of == fold


def flatten(pointers: DataFrame) -> DataFrame:
    """(v, p) with p <= v, followed to its end by pointer doubling."""
    while True:
        far = pointers.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        new = stored(
            pointers.join(far, pointers.p == far._v, "left").select(
                "v", F.coalesce("_p", "p").alias("p"), (F.coalesce("_p", "p") != F.col("p")).alias("moved")
            ),
            "pointers",
        )
        pointers = new.select("v", "p")
        if not new.where("moved").limit(1).count():
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every end of the edges (a, b): root is the smallest id reachable.

    Each round points every vertex to its smallest neighbour, follows the pointers to their ends and
    contracts the edges; a contracted vertex never comes back, so the rounds are few and no group is
    gathered anywhere.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    known = None
    while True:
        ends = left.select(F.col("b").alias("v"), F.col("a").alias("p")).union(left.select(F.col("a").alias("v"), F.col("a").alias("p")))
        step = flatten(stored(ends.union(left.select(F.col("a").alias("v"), F.col("b").alias("p"))).groupBy("v").agg(F.min("p").alias("p")).select("v", F.least("v", "p").alias("p")), "pointers"))
        if known is None:
            known = step
        else:
            to = step.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
            known = stored(known.join(to, known.p == to._v, "left").select("v", F.coalesce("_p", "p").alias("p")), "roots")
        x, y = step.select(F.col("v").alias("a"), F.col("p").alias("pa")), step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = stored(
            left.join(x, "a").join(y, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        if not left.limit(1).count():
            return known.select("v", F.col("p").alias("root"))


# --- text inside a task -------------------------------------------------------------------------------------


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow that gives the memory of its batches back at its end: a worker waits for its next task, and may wait long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library has it on Linux only
            trim(0)

    return run


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a text column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have at most ``most`` bytes, or one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 7)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if (known := len(_POWERS.get("up", ()))) < n:
        with np.errstate(over="ignore"):
            size = max(n, 2 * known, 1 << 16)
            for name, base in (("up", int(_ODD)), ("down", pow(int(_ODD), -1, 1 << 64))):
                step = np.full(size, base, np.uint64)
                step[0] = 1
                _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; ``cuts`` are positions no word crosses."""
    word = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[0], edge[-1] = (word[0], word[-1]) if len(data) else (False, False)
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    glued = inner[word[inner] & word[inner - 1]]
    places = np.flatnonzero(edge)
    if len(glued):
        places = np.sort(np.concatenate([places, glued, glued]))
    return places[0::2], places[1::2]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of ``word_table``."""
    return word_table(data, at)[:2]


def word_table(data: np.ndarray, at: np.ndarray, lower: bool = True, marks_off: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts data[at[i]:at[i+1]], the index of each word's text, and its first and end byte.

    Words are runs of bytes other than space and U+0009 to U+000D; A-Z are lower-cased if asked. The hash is
    a polynomial of the bytes, taken from prefix sums, then mixed; equal words have equal hashes everywhere.
    ``marks_off`` makes one closing mark after an ASCII letter or digit a word of its own. Works on pieces of bounded size that end between words.
    """
    found: list[tuple[np.ndarray, ...]] = []
    lo, end = int(at[0]), int(at[-1])
    while lo < end:
        hi = min(end, lo + SLICE)
        while hi < end and not _IS_SPACE[data[hi]]:
            gaps = np.flatnonzero(_IS_SPACE[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
                break
            nxt = np.flatnonzero(_IS_SPACE[data[hi : hi + SLICE]])
            hi = hi + int(nxt[0]) if len(nxt) else min(end, hi + SLICE)
        piece = data[lo:hi]
        first, last = np.searchsorted(at, (lo, hi), "left")
        start, stop = _spans(piece, at[first:last] - lo)
        if marks_off and len(start):
            off = np.flatnonzero((stop - start > 1) & _MARK[piece[stop - 1]] & _ALNUM[piece[np.maximum(stop - 2, 0)]])
            start = np.insert(start, off + 1, stop[off] - 1)
            whole = stop[off]
            stop[off] -= 1
            stop = np.insert(stop, off + 1, whole)
        if len(start):
            up, down = _powers(len(piece))
            with np.errstate(over="ignore"):
                total = np.zeros(len(piece) + 1, np.uint64)
                np.cumsum(_BYTE[LOWER[piece] if lower else piece] * up, out=total[1:])
                h = (total[stop] - total[start]) * down[start]
                h = mix(h + (stop - start).astype(np.uint64) * _ODD)
            found.append((h, np.searchsorted(at, start + lo, "right") - 1, start + lo, stop + lo))
        lo = hi
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def shingle_hashes(words: np.ndarray, owner: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and their texts' indexes; a text of 1 to k-1 words is one shorter window."""
    with np.errstate(over="ignore"):
        odd = [np.uint64((int(_ODD) * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF) for i in range(k)]
        size = max(0, len(words) - k + 1)
        full = owner[:size] == owner[k - 1 :] if size else np.zeros(0, bool)
        h = np.zeros(size, np.uint64)
        for i in range(k):
            h += words[i : i + size] * odd[i]
        h, who = mix(h[full], k), owner[:size][full]
        counts = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            at = np.concatenate([[0], np.cumsum(counts)])
            short = [mix(np.array([sum((int(w) * int(odd[j])) for j, w in enumerate(words[at[d] : at[d + 1]])) & 0xFFFFFFFFFFFFFFFF], np.uint64), int(counts[d]))[0] for d in few]
            h, who = np.concatenate([h, np.array(short, np.uint64)]), np.concatenate([who, few])
    return h, who


def distinct_by(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value), sorted by both."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]
