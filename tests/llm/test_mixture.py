import random

import pytest
from plain_versions import shared_out
from pyspark.sql import functions as F

from llm import mixture as M


def plain(rows, weights, seed, target, epochs):
    return shared_out([(i, t, (a, b)) for i, t, a, b in rows], weights, seed, target, epochs)


def drawn(spark, rows, weights, seed=3, target=None, epochs=4):
    df = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string").withColumns({"epoch": F.lit("own"), "passes": F.lit("own")})
    tree = {"domain": F.col("dom"), "language": F.col("lang")}
    leaves = M.plan(df, tree, weights, seed, target, epochs)
    got = M.draw(df, leaves, tree, seed).select("row.doc_id", "epoch", "row.passes").collect()
    assert {r.passes for r in got} <= {"own"}
    budgets = {(r.domain, r.language): r.budget for r in leaves.collect()}
    return budgets, sorted(((r.doc_id, r.epoch) for r in got), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice("aab"), rng.choice(["x", "y", "y", "z", None])) for i in range(n)]


@pytest.mark.parametrize("target,epochs", [(None, 4), (200, 4), (10**9, 2), (0, 3), (1500, 1)])
def test_equals_plain_sharing(spark, target, epochs):
    rows, weights = corpus(target or 1, 120), {("a",): 1, ("b",): 5, ("a", "x"): 7, ("b", "z"): 2}
    want_budget, want = plain(rows, weights, 3, target, epochs)
    budget, got = drawn(spark, rows, weights, 3, target, epochs)
    assert budget == {k: v for k, v in want_budget.items() if len(k) == 2} and got == want


def test_shortage_goes_to_siblings_first(spark):
    rows = [(1, "w " * 10, "a", "x"), (2, "w " * 500, "a", "y"), (3, "w " * 500, "b", "x")]
    budget, _ = drawn(spark, rows, {}, target=400, epochs=1)
    assert budget == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, "w " * 50_000, None, None), (None, "w w", "a", "y"), (5, "w", "a", "y"), (5, "w", "a", "y")]
    assert drawn(spark, rows, {})[1] == plain(rows, {}, 3, None, 4)[1]
    assert drawn(spark, [], {}) == ({}, [])
    with pytest.raises(ValueError):
        drawn(spark, rows, {("a",): 0})


@pytest.mark.parametrize("target", [None, 200, 777])
def test_words_within_budget_are_the_budget(spark, target):
    rows, weights = corpus(5, 120), {("a",): 1, ("b",): 5}
    df = spark.createDataFrame(rows, "doc_id long, text string, dom string, lang string")
    tree = {"domain": F.col("dom"), "language": F.col("lang")}
    leaves = M.plan(df, tree, weights, 3, target)
    got = M.within_budget(M.draw(df, leaves, tree, 3)).select("domain", "language", "epoch", "row.doc_id", "row.text").collect()
    taken = {}
    for r in got:
        taken[r.domain, r.language] = taken.get((r.domain, r.language), 0) + len((r.text or "").split())
    assert taken == {(r.domain, r.language): r.budget for r in leaves.collect() if r.budget}
    text = {i: t for i, t, *_ in rows}
    assert all(text[r.doc_id].startswith(r.text) for r in got) and sum(r.text != text[r.doc_id] for r in got) <= leaves.count()
