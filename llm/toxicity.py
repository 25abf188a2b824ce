"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

Fit, on a bounded sample of labelled rows: a word's log-odds between toxic and other texts under an informative
Dirichlet prior (the words' own frequencies), less ``BOUND`` standard errors, is its weight if that is positive;
every other word weighs ``-drift``, ``DRIFT`` or as much more as the background needs. A text's maximal segments (Ruzzo and Tompa, linear time) are its
candidate passages. Under the background of texts not labelled toxic, N words hold about K N exp(-lambda S)
segments of at least S: lambda solves the background's moment equation, K matches the segments counted there. A
passage is significant if that number is below ``MOST_EXPECTED``. A text's evidence is the sum over its
significant passages of -ln of it; one logistic curve turns evidence into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The fit's bound: labelled rows, in order of their ids' hashes. Every word of theirs may have a weight.
SAMPLE_ROWS = 20_000
#: The prior's weight as a share of the texts counted.
PRIOR, BOUND, DRIFT, MOST_EXPECTED = 0.05, 3.0, 0.1, 0.05

_TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    base: float = -3.0  # the curve: base + slope * evidence
    slope: float = 0.0
    drift: float = DRIFT  # what a word without a weight costs


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence, left to right, in linear time."""
    # first, end, sum before, sum at the end, and the nearest earlier one that starts lower: what lies between
    # starts at least as high, so a search may jump over it.
    found: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        first, before = i, total
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, i + 1, before, total, j))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, z - y) for a, b, y, z, _ in found]


def passages(text: str | None, weights: dict[str, float], drift: float = DRIFT) -> tuple[int, int, list[tuple[int, int, float]]]:
    """Words, words with a weight, and the maximal segments in words."""
    words = _TOKEN.findall(text.lower()) if text else []
    hits = [i for i, w in enumerate(words) if w in weights]
    # Runs of words without a weight are one step: a maximal segment starts and ends with a weight.
    scores, places, last = [], [], None
    for i in hits:
        if last is not None and i > last + 1:
            scores.append(-drift * (i - last - 1))
            places.append((last + 1, i))
        scores.append(weights[words[i]])
        places.append((i, i + 1))
        last = i
    return len(words), len(hits), [(places[a][0], places[b - 1][1], s) for a, b, s in segments(scores)]


def finder(weights: dict[str, float]):
    """Whether a lower-cased text holds a weighted word at all, be it inside another word: most texts need no more."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w in weights:
        automaton.add_word(w, True)
    if not weights:
        return lambda text: False
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text), None) is not None


def evidence(n: int, found: list[tuple[int, int, float]], model: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    """-ln of the expected number, summed over significant passages, and those with that number."""
    kept = [(a, b, s, model.scale * n * math.exp(-min(700.0, model.rate * s))) for a, b, s in found]
    kept = [x for x in kept if x[3] < MOST_EXPECTED]
    return sum(-math.log(max(x[3], 1e-300)) for x in kept), kept


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    Of labelled rows SAMPLE_ROWS are used, in order of their ids' hashes; rows with a null label, text or id are not.
    Texts whose three-word windows have the same least hash count once, as toxic if any of them is: equal texts
    always, near copies mostly, so a copied text's own words don't look like signs. Without a word of positive weight every text scores
    the share of toxic rows.
    """
    chosen = (
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE_ROWS).select("doc_id", "toxic")
    )
    # At most SAMPLE_ROWS rows of 16 bytes: a bound on what is broadcast.
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    words = sample.withColumn("w", F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)))
    least = F.array_min(F.transform(at, lambda i: F.xxhash64(F.element_at("w", i), F.try_element_at("w", i + 1), F.try_element_at("w", i + 2))))
    one = words.groupBy(least.alias("h")).agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"), F.max("toxic").cast("int").alias("toxic"))
    sample = stored(one.select("text", "toxic"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = (Counter(), Counter())
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                by[int(y > 0)].update(set(_TOKEN.findall(t.lower())))
            every = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), pa.array([by[1][w] for w in every], pa.int64()), pa.array([by[0][w] for w in every], pa.int64())], ["word", "a", "b"]
            )

    sizes = sample.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("b")).first()
    na, nb = sizes.a or 0, sizes.b or 0
    if not na or not nb:
        return Model(base=-math.log((nb + 1) / (na + 1)))
    own = PRIOR * (na + nb)
    prior = PRIOR * (F.col("a") + F.col("b"))
    pa_, pb = F.col("a") + prior, F.col("b") + prior
    odds = F.ln(pa_ / (na + own - pa_ + 1)) - F.ln(pb / (nb + own - pb + 1))
    words = sample.mapInArrow(count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = (
        words.where("a > 0").withColumn("weight", odds - BOUND * F.sqrt(1 / pa_ + 1 / pb)).where("weight > 0")
        .orderBy(F.desc("weight"), "word").select("word", "weight", "b").collect()  # words of SAMPLE_ROWS texts at most
    )
    n = sample.where("toxic <= 0").agg(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+"))).alias("n")).first().n or 0
    weights = {r.word: r.weight for r in best}
    chance = {r.word: (r.b + 0.5) / (n + 1) for r in best}
    if not weights:
        return Model(base=-math.log((nb + 1) / (na + 1)))
    # A word of the background costs at least half the drift on average, else segments would grow without end.
    drift = max(DRIFT, 2 * sum(p * weights[w] for w, p in chance.items()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [passages(t, weights, drift) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([[s for *_, s in x[2]] for x in got], pa.list_(pa.float64()))],
                ["toxic", "n", "hits", "scores"],
            )

    rows = sample.mapInArrow(measure, "toxic int, n long, hits long, scores array<double>").collect()  # SAMPLE_ROWS at most
    clean = [r for r in rows if r.toxic <= 0]
    n, rest = sum(r.n for r in clean), max(0.0, 1 - sum(chance.values()))
    low, high = 1e-6, 50.0
    for _ in range(200):  # the positive root of the sum over words of chance * e^(x weight) + rest * e^(-x drift) = 1
        x = (low + high) / 2
        sums = sum(p * math.exp(min(500.0, x * weights[w])) for w, p in chance.items()) + rest * math.exp(-x * drift)
        low, high = (x, high) if sums < 1 else (low, x)
    rate, least = low, min(weights.values())
    seen = sum(s >= least for r in clean for s in r.scores) + 0.5
    scale = min(1.0, seen / max(1.0, n) * math.exp(min(700.0, rate * least)))
    model = Model(weights, rate, scale)
    x = np.array([min(50.0, evidence(r.n, [(0, 0, s) for s in r.scores], model)[0]) for r in rows])
    y = np.array([r.toxic > 0 for r in rows], float)
    b, k = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.1
    for _ in range(100):  # Newton, with a little shrinkage of the slope
        p = 1 / (1 + np.exp(-np.clip(b + k * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 0.1 * k])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        step = np.linalg.solve(h, g)
        b, k = b + float(np.clip(step[0], -2, 2)), max(0.0, k + float(np.clip(step[1], -2, 2)))
        if abs(step).max() < 1e-9:
            break
    return Model(weights, rate, scale, b, k, drift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and passages (first word, end word, score, expected) of every whole text of (doc_id, text).

    Null and empty texts have no passage and the score of a text without one. Other columns are not read;
    repeated rows are scored each.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        possible = finder(m.weights)
        for batch in batches:
            scores, found = [], []
            for t in batch.column("text"):
                text = (t.as_py() or "").lower()
                n, _, segs = passages(text, m.weights, m.drift) if possible(text) else (0, 0, [])
                x, kept = evidence(n, segs, m) if segs else (0.0, [])
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m.base + m.slope * min(50.0, x))))))
                found.append([dict(zip(("first", "end", "score", "expected"), p)) for p in kept])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, kind)], ["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(mark, "doc_id long, score double, passages array<struct<first: long, end: long, score: double, expected: double>>")
