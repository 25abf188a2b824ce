"""Order-dependent operators that never put one key's whole history into one task.

A window partitioned by session makes a session with a third of all rows one task. These
operators cut each key's order into chunks of fixed width, work inside the chunks in
parallel, and carry one summary row per chunk across (W2, W3, W8, W10).

Each reads its input twice (rows and chunk summaries), so callers hand in narrow, written
tables: keys, order and the few columns that decide. Texts join back once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

CHUNK = 65_536
# For orders that hold the line number above 31 bits (``seq``): as many lines a chunk.
SEQ_CHUNK = CHUNK << 31


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))


def carry_forward(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], before: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """Add, per name in ``values``, the last non-null value at or before each row.

    ``before`` leaves the row itself out. ``order`` must be a unique integer per key.
    """
    slots = {name: f"_value_{name}" for name in values}
    rows = _chunked(df, order, chunk).select("*", *[v.alias(slots[n]) for n, v in values.items()])
    local = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        rows.groupBy(*keys, "_chunk")
        .agg(*[F.max_by(s, F.when(F.col(s).isNotNull(), F.col(order))).alias(s) for s in slots.values()])
        .select(*keys, "_chunk", *[F.last(s, ignorenulls=True).over(across).alias(f"_carried_{n}") for n, s in slots.items()])
    )
    within = rows.select("*", *[F.last(s, ignorenulls=True).over(local).alias(f"_local_{n}") for n, s in slots.items()])
    return within.join(summary, [*keys, "_chunk"], "left").select(
        *df.columns, *[F.coalesce(f"_local_{n}", f"_carried_{n}").alias(n) for n in values]
    )


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the key."""
    rows = _chunked(df, order, chunk).withColumn("_step", value.cast("bigint"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_step").alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_local", F.coalesce(F.sum("_step").over(local), F.lit(0)))
        .join(offsets, [*keys, "_chunk"])
        .select(*df.columns, (F.col("_offset") + F.col("_local")).alias(name))
    )


def number_rows(df: DataFrame, keys: list[str], order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Add ``name``: 0, 1, 2 … per key in ``order``."""
    return running_total(df, keys, order, F.lit(1), name, chunk)


def since_last(df: DataFrame, keys: list[str], order: str, marker: Column) -> DataFrame:
    """Rows from the last marked one on; all rows where none is marked."""
    cuts = df.where(marker).groupBy(*keys).agg(F.max(order).alias("_cut"))
    return (
        df.join(cuts, keys, "left")
        .where(F.col("_cut").isNull() | (F.col(order) >= F.col("_cut")))
        .drop("_cut")
    )


def islands(narrow: DataFrame, keys: list[str], order: str, side: str, chunk: int = CHUNK) -> DataFrame:
    """Add ``island``: the order of the first of the neighbouring rows with the same ``side``."""
    before = carry_forward(narrow, keys, order, {"_before": F.struct(F.col(side).alias("side"))}, before=True, chunk=chunk)
    starts = before.select(
        *narrow.columns,
        F.when(F.col("_before").isNull() | (F.col("_before.side") != F.col(side)), F.col(order)).alias("_start"),
    )
    return carry_forward(cut_lineage(starts), keys, order, {"island": F.col("_start")}, chunk=chunk).drop("_start")


def joined_texts(rows: DataFrame, placed: DataFrame, keys: list[str], order: str, text: str, glue: str) -> DataFrame:
    """``keys, island, text``: the texts of each island in order. A merged turn is one value, so an island's
    texts do meet; islands are spread by key and island."""
    texts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return (
        rows.join(placed.select(*keys, order, "island"), [*keys, order])
        .groupBy(*keys, "island")
        .agg(texts.alias("_texts"))
        .select(*keys, "island", F.array_join(F.transform("_texts", lambda x: x["t"]), glue).alias(text))
    )


def merge_neighbours(df: DataFrame, keys: list[str], order: str, side: str, text: str, glue: str) -> DataFrame:
    """Neighbouring rows with the same ``side`` become one row with their texts joined.

    Returns keys, ``order`` (of the first row), ``side`` and ``text``.
    """
    placed = cut_lineage(islands(cut_lineage(df.select(*keys, order, side)), keys, order, side))
    heads = placed.where(F.col(order) == F.col("island")).select(*keys, "island", side)
    merged = joined_texts(df.select(*keys, order, text), placed, keys, order, text, glue)
    return merged.join(heads, [*keys, "island"]).select(*keys, F.col("island").alias(order), side, text)
