"""Benchmark decontamination by pigeonhole edit matching over words.

An item of m words may occur in a text with up to ``k = m * percent // 100`` word edits (a word replaced, added or left
out). Cut into k + 1 pieces, at least one piece then occurs unchanged. All pieces are looked for at once
(Aho-Corasick over the normalised text); around each hit Myers' bit-parallel algorithm, one step per word, gives
the least distance of the item to any part of the text.

Words are runs of letters, digits and underscores, lower-cased; a letter of a script that is written without spaces between
words (Chinese, Japanese, Thai, Lao, Khmer, Burmese) is a word of its own. Items too short for an edit must occur unchanged.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

PERCENT = 20
#: Items with fewer words are not looked for; 1: all items with a word are.
LEAST_WORDS = 1
#: Letters of scripts without spaces between words, as ranges of code points (fixed values).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Characters of items that one pass over the texts holds; more items mean more passes.
PASS_CHARS = 8 << 20

_TOKEN = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
#: The index a worker process made last, by the name of its pass.
_MADE: dict[str, Index] = {}


def words(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 consecutive ranges of m words, as equal as can be."""
    return [(i * m // (k + 1), (i + 1) * m // (k + 1)) for i in range(k + 1)]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least distance of the pattern to any part of the text, and the first place where such a part ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    has: dict[str, int] = {}
    for i, w in enumerate(pattern):
        has[w] = has.get(w, 0) | 1 << i
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = has.get(w, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        less = plus & across
        if up & top:
            score += 1
        elif less & top:
            score -= 1
        up, less = (up << 1) & full, (less << 1) & full
        plus = less | (full & ~(down | up))
        minus = up & down
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """The pieces of a bounded set of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], percent: int = PERCENT, least: int = LEAST_WORDS):
        import ahocorasick

        self.items = [(i, w) for i, w in ((i, words(t)) for i, t in items) if len(w) >= max(1, least)]
        self.budget = [len(w) * percent // 100 for _, w in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for x, ((_, w), k) in enumerate(zip(self.items, self.budget)):
            for a, b in pieces(len(w), k):
                found.setdefault(" " + " ".join(w[a:b]) + " ", []).append((x, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int]]:
        """(item id, least distance, end word) of every item that occurs in the text within its budget."""
        if not text or not self.items:
            return []
        found = words(text)
        hits: dict[int, list[int]] = {}
        starts = None
        for end, (size, where) in self.automaton.iter(" " + " ".join(found) + " "):
            if starts is None:
                starts, at = [], 0
                for w in found:
                    starts.append(at)
                    at += len(w) + 1
            place = bisect_right(starts, end - size + 1) - 1
            for x, offset in where:
                hits.setdefault(x, []).append(place - offset)
        out = []
        for x, places in hits.items():
            item, pattern = self.items[x]
            k, m, best = self.budget[x], len(pattern), None
            spans: list[list[int]] = []
            for p in sorted(set(places)):
                low, high = max(0, p - k), p + m + k
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            for low, high in spans:
                distance, end = myers(pattern, found[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, low + end)
            if best:
                out.append((item, *best))
                if first_only:
                    break
        return out


def _passes(benchmark: DataFrame, percent: int, least: int) -> Iterator[Index]:
    """Indexes over parts of the benchmark of bounded size: their number grows with it, not their size."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // PASS_CHARS) or 1
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield Index([(r.item_id, r.text) for r in some.orderBy("item_id", "text").collect()], percent, least)


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, item_id, distance, end_word: every occurrence within budget, the best of each text and item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not read. Null and empty
    texts and items match nothing, nor do items of fewer than ``least`` words or with a null id. Rows of one doc_id are one
    document, and so are rows with a null one: of each item its best match is reported once. So is a repeated item. Ties: the
    first end.
    """
    spark, out = docs.sparkSession, None
    for index in _passes(benchmark, percent, least):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, index.items, percent))

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _rebuilt(*shared.value)
            for batch in batches:
                rows = [
                    (d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for hit in index.search(t.as_py())
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["doc_id", "item_id", "distance", "end_word"]
                )

        found = docs.select("doc_id", "text").mapInArrow(tidy(look), "doc_id long, item_id long, distance long, end_word long")
        out = found if out is None else out.union(found)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_word")).alias("best")).select(
        "doc_id", "item_id", "best.distance", "best.end_word"
    )


def _rebuilt(name: str, items: list[tuple[int, list[str]]], percent: int) -> Index:
    """The index of a pass, made once in a worker process."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Index([(i, " ".join(w)) for i, w in items], percent, 1)
    return _MADE[name]


def without_matches(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with their columns as they are."""
    spark, schema = docs.sparkSession, docs.schema
    for index in _passes(benchmark, percent, least):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, index.items, percent))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _rebuilt(*shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not index.search(t.as_py(), True) for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(tidy(keep), schema)
    return docs
