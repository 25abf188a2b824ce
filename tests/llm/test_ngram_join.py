import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from plain_versions import corpus, plain

from llm import ngram_join as N
from llm.common import components

def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("groups,size,edits", [(40, 4, 3), (2, 60, 6)])
def test_equals_all_pairs(docs, groups, size, edits):
    rows = corpus(groups, groups, size, edits)
    assert result(N.jaccard_components(docs(rows))) == plain(rows)


def test_blocks_of_a_large_group(docs, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = corpus(5, 1, 150, 5) + [(1, "a b c d"), (2, "a b c d")]
    assert result(N.jaccard_components(docs(rows))) == plain(rows)


def test_odd_rows(docs):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (8, long), (9, long + " more"), (10, "é É"), (11, "a b c d")]
    want = plain(rows)
    assert want[9][1] == 8 and want[5][1] == 4 and want[7][1] == 6
    assert result(N.jaccard_components(docs(rows + [(4, "One"), (6, "one two")]))) == want


def test_one_stays(docs):
    given = docs([(3, "a b c d"), (1, "a b c d"), (2, None), (None, "a b c d"), (5, "x y z")])
    kept = N.one_of_each_group(given)
    assert kept.columns == given.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5]


def test_no_rows(docs):
    assert N.jaccard_components(docs([])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (60, 50), (50, 55), (55, 60)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = defaultdict(int) | {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {60: 50, 55: 50, 50: 50}
    assert got == want


@pytest.fixture
def common_tokens(monkeypatch):
    """Texts whose tokens are in some 20 texts each, of few of which counts are known, and what is written for them: lists of single tokens would bring all into one group."""
    rng = random.Random(4)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(150)]
    rows = list(enumerate(" ".join(rng.sample(lines, 10)) for _ in range(300)))
    rows += [(300, rows[7][1] + " a"), (301, "z " + rows[9][1])]
    written = {}
    real = N.stored
    monkeypatch.setattr(N, "stored", lambda df, label: written.setdefault(label, real(df, label)))
    monkeypatch.setattr(N, "FREQUENT", 4)
    return rows, written


def test_unlike_texts_of_common_tokens_do_not_meet(docs, common_tokens):
    rows, written = common_tokens
    assert result(N.jaccard_components(docs(rows))) == plain(rows)
    assert written["alive"].count() < 30


def test_the_stage_compares_few_of_them(spark, docs, common_tokens):
    rows, written = common_tokens
    kept = corpus_pipeline.near_copies(spark, docs(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, root) in plain(rows).items() if i == root)
    assert written["alive"].count() < 30


@pytest.mark.parametrize("turns", [0, 2])
def test_crowded_lists_by_turns_and_bitmaps(docs, monkeypatch, turns):
    for name, value in (("LIST_PAIRS", 1), ("TURNS", turns), ("BITMAPS", 8)):
        monkeypatch.setattr(N, name, value)
    rows = corpus(6, 3, 50, 8) + [(1, "a b c d"), (2, "a b c d")]
    assert result(N.jaccard_components(docs(rows))) == plain(rows)


@pytest.mark.parametrize("percent", [90, 60])
def test_sets_within_the_threshold_share_a_part(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = rng.integers(1, 1 << 63, n, np.uint64)
        out = int(rng.integers(0, n * (100 - percent) // 100 + 1))
        b = np.concatenate([a[out:], rng.integers(1, 1 << 63, max(0, (100 * (n - out) - percent * n) // percent), np.uint64)])
        assert N._enough(np.sort(a), np.sort(b), percent)
        size = np.array([len(a), len(b), 0])
        x, y, empty = N._parts(np.repeat([0, 1], size[:2]), np.concatenate([a, b]), size, percent).to_pylist()
        assert set(x) & set(y) or set(a.tolist()) == set(b.tolist())
        assert empty == []
