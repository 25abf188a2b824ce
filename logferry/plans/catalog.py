"""The session catalog (K15; W5, W7, O1, O2, H12, H19, H37)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values as V
from ..functions.let import first_of
from ..functions.text import ago, plain, short_line
from ..sources.sessions import KEYS, titles_a, titles_b


def session_catalog(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``keys, agent, modified, title`` of every session with something in it, from lines with ``modified``."""
    is_a = F.col("agent") == V.AGENT_A
    titles = titles_a(lines.where(is_a)).unionByName(titles_b(lines.where(~is_a), names))
    used = lines.groupBy(*KEYS, "agent").agg(F.max("modified").alias("modified"))
    return used.join(titles, KEYS).select(*KEYS, "agent", "modified", "title")


def described(catalog: DataFrame, now: Column) -> DataFrame:
    """The catalog in words: label, age, title on one line."""
    label = first_of(*[(F.col("agent") == a, F.lit(n)) for a, n in V.LABELS.items()])
    return catalog.select(
        *KEYS,
        label.alias("label"),
        ago(F.col("modified"), now).alias("age"),
        short_line(plain(F.col("title")), 70).alias("title"),
        F.left("session_id", F.lit(8)).alias("short_id"),
        "modified",
    )


def latest(catalog: DataFrame, by: list[str], n: int = 1) -> DataFrame:
    """The ``n`` most recently used sessions per folder, agent … (W5). The rank limit runs before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.col("modified").desc(), *[F.col(k) for k in KEYS])
    return catalog.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def most_recent(catalog: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most recently used sessions of all (O1, O2)."""
    return catalog.orderBy(F.col("modified").desc(), *KEYS).limit(n)
