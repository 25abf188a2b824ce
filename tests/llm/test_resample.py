"""Importance resampling against a plain version over words and counters."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from llm import resample
from llm.queries_c import op11_importance_resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=5, least=20):
    """Sorted (doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    s, t = Counter(b for _, x in docs for b in grams(x)[1]), Counter(b for x in target for b in grams(x)[1])
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10000)]
    out = []
    for i, x in docs:
        n, b = grams(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[v] for v in b)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    for place, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = place + 1
    return order(tuple(r[:5]) for r in out)


def order(rows):
    return sorted(rows, key=lambda t: tuple((x is None, x or 0) for x in t))


def rows_of(df):
    return order(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert rows_of(op11_importance_resample(spark, folder)) == plain(docs, target)


def test_odd_texts_ties_and_repeats(spark, docs):
    prose = "Der alte Mann ging über die Straße und sah 27 Häuser, rot-blau_grün; x'y Ünder İST K end "
    rows = [(i, prose * (i % 5) + f"tail {i % 7} of A_b-c\x00d\x7fe {i}") for i in range(90)]
    rows += [(7, rows[7][1])] * 40 + [(None, prose * 3), (None, None), (200, None), (201, ""), (202, "..."), (203, "日本語 テキスト é" * 9), (204, "Wort " * 60000), (205, "w" * 70000)]
    target = ["die Straße und sah", None, "", "Wort wort", "日本語"]
    df, aim = docs(rows).repartition(5), spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    model = resample.fit(df, aim)
    assert rows_of(resample.resample(df, model)) == plain(rows, target)
    assert rows_of(resample.resample(df, model, percent=100, least=0)) == plain(rows, target, 100, 0)
    ids = {r[0] for r in plain(rows, target) if r[4]}
    kept = resample.drawn(df, aim)
    assert kept.columns == df.columns and order((r.doc_id, r.text) for r in kept.collect()) == order(r for r in rows if r[0] in ids)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(2, "")]])
def test_empty_tables(spark, docs, rows):
    aim = spark.createDataFrame([], "text string")
    assert rows_of(resample.resample(docs(rows), resample.fit(docs(rows), aim), percent=100, least=0)) == plain(rows, [], 100, 0)


def test_no_ngram_crosses_two_texts():
    texts = [b"a b", b"", b"c", b"d e f g"]
    bucket, where, words = resample.features(texts)
    assert words.tolist() == [2, 0, 1, 4] and sorted(where.tolist()) == [0] * 3 + [2] + [3] * 9
    assert sorted(bucket[where == 0].tolist()) == sorted(grams("a b")[1])
