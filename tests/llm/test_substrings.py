"""Exact substring dedup and its suffix arrays against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm import substrings, suffixes
from llm.queries_c import op13_suffix_dedup

FIELDS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def cut(texts, length):
    """Of each text, the flags of its removed bytes."""
    data = [(t or "").encode() for t in texts]
    times = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if times[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((x, gone))
    return out


def plain(rows, length):
    out = []
    for (i, _), (x, gone) in zip(rows, cut([t for _, t in rows], length)):
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return order(out)


def order(rows):
    return sorted(rows, key=lambda t: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in t))


def rows_of(df):
    return order(tuple(r) for r in df.select(*FIELDS).collect())


def test_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = plain(docs, 400)
    assert rows_of(op13_suffix_dedup(spark, folder)) == want and any(r[2] for r in want)


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 12)))
    shared = [word() * 3 for _ in range(4)] + ["x" * 50, "ab" * 30]
    rows = [(i, "".join(rng.choice([word(), word(), word(), rng.choice(shared)]) for _ in range(rng.randint(0, 8)))) for i in range(n)]
    rows += [(3, rows[3][1])] * (n // 3) + [(None, rows[5][1]), (None, None), (n, None), (n + 1, ""), (n + 2, "z"), (n + 3, rows[7][1])]
    return rows


@pytest.mark.parametrize("shard, crowded", [(1 << 20, 1 << 22), (60, 1 << 22), (1 << 20, 40), (60, 0)])
def test_odd_texts_at_small_lengths(docs, shard, crowded):
    rows = made(shard + crowded, 60)
    df = docs(rows).repartition(4)
    assert rows_of(substrings.repeats(df, 16, 6, shard, crowded)) == plain(rows, 16)


def test_long_and_periodic_texts(docs):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(60000))
    rows = [(1, "a" * 3000), (2, "ab" * 800 + "c" + "ab" * 200), (3, long), (4, long[20000:20399] + "|" + long[30000:30400]), (5, long[:1000] + "é" + long[500:900]), (6, "a" * 400)]
    want = plain(rows, 400)
    assert rows_of(substrings.repeats(docs(rows))) == want
    assert want[3][2] == 400 and want[5][2] == 400


def test_kept_bytes_and_columns(docs):
    rows = made(9, 40)
    df = docs(rows)
    kept = substrings.without_repeats(df, 16, 6)
    want = [bytes(b for b, g in zip(x, gone) if not g) for x, gone in cut([t for _, t in rows], 16)]
    assert kept.columns == [*df.columns, "kept"]
    assert order((r.doc_id, r.text, bytes(r.kept).hex()) for r in kept.collect()) == order((i, t, k.hex()) for (i, t), k in zip(rows, want))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(2, ""), (2, "")], [(3, "a" * 399)] * 3])
def test_nothing_to_remove(docs, rows):
    assert rows_of(substrings.repeats(docs(rows))) == plain(rows, 400)


@pytest.mark.parametrize("crowd", [0.001, 1e9])
def test_suffix_arrays_by_both_ways(monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "_CROWD", crowd)
    rng = random.Random(5)
    for _ in range(400):
        top = rng.choice([1, 2, 3, 12])
        t = [rng.randint(1, top) for _ in range(rng.randint(0, 50))] * rng.choice([1, 1, 3]) + [0]
        got = suffixes.suffix_array(np.array(t), top + 1)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert got.tolist() == want
        phi, length = suffixes.common_prefixes(np.array(t, np.uint16), got)
        for a, b in zip(want, want[1:]):
            n = next(k for k in range(len(t)) if t[a + k] != t[b + k])
            assert (phi[b], length[b]) == (a, n)


def test_segments_hold_each_start_once_in_any_pieces(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 12, 40, 300]))) for _ in range(50)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    every = {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 11)}
    for piece in (1 << 21, 64, 17):
        monkeypatch.setattr(substrings, "_PIECE", piece)
        anchors, seen = {}, []
        for text, start, n, key in substrings.segments(data, at, 12, 5):
            for d, a, m, k in zip(text.tolist(), start.tolist(), n.tolist(), key.tolist()):
                seen += [(d, a + i) for i in range(m)]
                for i in range(a, a + m):
                    assert anchors.setdefault(texts[d][i : i + 12], k) == k  # equal strings, equal anchors
        assert len(seen) == len(every) and set(seen) == every
