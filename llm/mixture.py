"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens goes down a tree of columns (domain, language, source). A node shares its budget among its
children by their weights. A child that has too little, at ``epochs`` passes over its text, gives all it has; its
shortage goes to its siblings by their weights, and only what a whole family lacks goes to the
family's siblings. That is water filling at every node, under the capacities of whole subtrees.

A leaf takes full passes over its documents and then a prefix of one more pass, in an order seeded by the
pass. The prefix ends inside the document in which the budget is used up: ``draw`` gives that document whole with the
number of its tokens that count, ``within_budget`` cuts its text there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, stored

#: What a null counts as in a level's column.
NONE = "(none)"


def n_words(text: str = "text") -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pass_key(seed: int, turn: Column, doc_id: str = "doc_id") -> Column:
    """A document's place in a pass, as a hexadecimal text; rows of one doc_id stand together."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(NONE))).cast("binary"))


def share(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """``nodes`` (family columns, name, cap, weight, budget of the family) with ``share``: water filling in each family.

    Whole tokens: those left by rounding down go by the largest remainder, then by name. A family of
    any budget up to its capacity is served in full. Weights are positive.
    """
    of = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = of.orderBy(F.expr("cast(cap as decimal(38,9)) / weight").asc_nulls_last(), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumns(
        {
            "used": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("decimal(19,0)"),
            "open": F.sum("weight").over(after).cast("decimal(19,0)"),
        }
    )
    n = n.withColumn("full", F.expr("cast(cap as decimal(19,0)) * open <= (budget - used) * cast(weight as decimal(19,0))"))
    n = n.withColumn("full", F.min("full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    n = n.withColumns(
        {
            "remain": F.expr("cast(budget as decimal(19,0))") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(of), F.lit(0)),
            "claim": F.sum(F.when(~F.col("full"), F.col("weight"))).over(of),
        }
    )
    n = n.withColumn("exact", F.expr("cast(remain as decimal(19,0)) * cast(weight as decimal(19,0))").cast("decimal(38,0)"))
    n = n.withColumns({"down": F.expr("cast(exact div claim as bigint)"), "rest": F.expr("cast(exact % claim as decimal(38,0))")})
    n = n.withColumn("over", F.col("remain").cast("long") - F.sum(F.when(~F.col("full"), F.col("down"))).over(of))
    place = F.row_number().over((Window.partitionBy(*family, "full") if family else Window.partitionBy("full")).orderBy(F.desc("rest"), name))
    n = n.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.col("down") + (place <= F.col("over")).cast("long")).cast("long"))
    return n.select(*nodes.columns, "share")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple, int], target: int | None, epochs: int) -> DataFrame:
    """``leaves`` (levels, n_tokens) with ``budget``. ``weights`` maps a node's path to its weight; 1 where it has none."""
    spark = leaves.sparkSession
    cap = leaves.withColumn("cap", F.col("n_tokens") * epochs)
    if any(w < 1 for w in weights.values()):
        raise ValueError("a weight is a positive whole number")
    every = cap.agg(F.sum("cap").alias("cap"), F.sum("n_tokens").alias("n")).first()
    whole = min(every.n or 0 if target is None else target, every.cap or 0)
    given_to = None
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        nodes = cap.groupBy(*path).agg(F.sum("cap").alias("cap"))
        given = [(*p, int(w)) for p, w in weights.items() if len(p) == depth]
        kinds = [*[(c, pa.string()) for c in path], ("weight", pa.int64())]
        # From Arrow, so executors start no Python workers for a few rows.
        table = pa.table({c: pa.array([x[i] for x in given], kind) for i, (c, kind) in enumerate(kinds)})
        nodes = nodes.join(spark.createDataFrame(table), path, "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
        nodes = nodes.withColumn("budget", F.lit(whole).cast("long")) if given_to is None else nodes.join(given_to, path[:-1])
        given_to = stored(share(nodes, path[:-1], path[-1]).select(*path, F.col("share").alias("budget")), "budgets")
    return cap.join(given_to, levels).select(*levels, "n_tokens", "budget")


def plan(docs: DataFrame, tree: dict[str, Column], weights: dict[tuple, int], seed: int, target: int | None = None, epochs: int = 4, tokens: Column | None = None) -> DataFrame:
    """A row per leaf: levels, n_tokens, budget, passes, rest, last_key, last_taken.

    Documents are taken whole in passes 0 to passes - 1, and in the next one those up to ``last_key``, of
    which the last counts ``last_taken`` tokens. ``target``: tokens of the mix (of all documents, if not given);
    a target beyond ``epochs`` passes over everything gives those. ``tree`` has the levels from the top, by name; null
    counts as (none). A null text has no tokens. An empty table gives no leaves.
    """
    levels = list(tree)
    names = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(name) for name, c in tree.items()]
    narrow = stored(docs.select("doc_id", *names, (n_words() if tokens is None else tokens).alias("n")), "tokens")
    leaves = stored(narrow.groupBy(*levels).agg(F.sum("n").alias("n_tokens")), "leaves")
    leaf = stored(
        budgets(leaves, levels, weights, target, epochs).withColumns(
            {"passes": F.when(F.col("n_tokens") > 0, F.expr("budget div n_tokens")).otherwise(0), "rest": F.when(F.col("n_tokens") > 0, F.expr("budget % n_tokens")).otherwise(0)}
        ),
        "plan",
    )
    # The last document of the prefix, found in three steps over ever smaller ranges of keys, so no window holds a leaf.
    rows = narrow.join(leaf.where("rest > 0").select(*levels, "passes", "rest"), levels).withColumn("key", pass_key(seed, F.col("passes")))
    rows, at = rows.withColumn("skipped", F.lit(0).cast("long")), []
    for step in (1, 2):
        by = F.substring("key", 2 * step - 1, 2).alias(f"k{step}")
        sums = rows.groupBy(*levels, *at, "rest", "skipped", by).agg(F.sum("n").alias("n"))
        start = F.col("skipped") + F.coalesce(F.sum("n").over(Window.partitionBy(*levels).orderBy(f"k{step}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = sums.withColumn("start", start).where("start < rest and start + n >= rest").select(*levels, *at, f"k{step}", "start")
        at.append(f"k{step}")
        rows = rows.withColumn(f"k{step}", by).join(edge, [*levels, *at]).withColumn("skipped", F.col("start")).drop("start")
    one = rows.groupBy(*levels, "rest", "skipped", "key").agg(F.sum("n").alias("n"))
    start = F.col("skipped") + F.coalesce(F.sum("n").over(Window.partitionBy(*levels).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = one.withColumn("start", start).where("start < rest").groupBy(*levels).agg(F.max(F.struct("key", (F.col("rest") - F.col("start")).alias("taken"))).alias("last"))
    return stored(leaf.join(last, levels, "left").select(*leaf.columns, F.col("last.key").alias("last_key"), F.col("last.taken").alias("last_taken")), "mix")


def draw(docs: DataFrame, leaves: DataFrame, tree: dict[str, Column], seed: int) -> DataFrame:
    """``docs`` as a struct ``row`` with the levels and ``epoch``, once for each pass that takes it, and ``last_taken`` for a prefix's last.

    Columns of ``docs`` may have any names, also those of the levels. Rows of one doc_id (null ids too) have one place in a
    pass and are taken together, each once; ``last_taken`` holds for each of them. Null and empty texts are taken with the
    passes of their leaf. An empty table, or a plan without leaves, gives no rows.
    """
    names = [F.coalesce(c.cast("string"), F.lit(NONE)).alias(name) for name, c in tree.items()]
    keyed = docs.select(F.struct("*").alias("row"), *names).join(leaves.select(*tree, "passes", "last_key", "last_taken"), list(tree))
    keyed = keyed.withColumn("key", pass_key(seed, F.col("passes"), "row.doc_id"))
    more = F.coalesce((F.col("key") <= F.col("last_key")).cast("long"), F.lit(0))
    turns = F.col("passes") + more
    return keyed.where(turns > 0).select(
        "row", *tree, F.explode(F.sequence(F.lit(0).cast("long"), turns - 1)).alias("epoch"), "passes",
        F.when(F.col("key") == F.col("last_key"), F.col("last_taken")).alias("last_taken"),
    )


def within_budget(drawn: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``draw`` with the text in ``row`` cut after the word in which the leaf's budget is used up.

    Only the last document of a leaf's last pass is cut, in that pass; white space before its words stays as it is. With one
    row for each doc_id the words of a leaf's rows are then its budget.
    """
    whole = F.col("row")[text]
    words = F.regexp_extract_all(whole, F.lit(rf"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    last = (F.col("epoch") == F.col("passes")) & F.col("last_taken").isNotNull()
    cut = F.when(last, F.array_join(F.slice(words, F.lit(1), F.col("last_taken").cast("int")), "")).otherwise(whole)
    return drawn.withColumn("row", F.col("row").withField(text, cut))
