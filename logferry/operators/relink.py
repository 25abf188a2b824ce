"""Re-pointing links past removed lines to the nearest kept ancestor."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

KEYS = ["project_id", "session_id"]


def resolve_removed(removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``uuid → target`` for removed lines (``uuid, parent, line_no``), and the ids caught in a cycle.

    Pointer doubling: each round every pointer jumps as far as all rounds before together, so a
    chain of n removed lines takes log2(n) joins on (session, uuid). A pointer still inside the
    removed set when a round settles none is on a cycle: its target is null and it is reported.
    """
    pointers = removed.groupBy(*KEYS, "uuid").agg(F.max_by("parent", "line_no").alias("target"))
    pointers = cut_lineage(pointers)
    hops = pointers.select(*KEYS, F.col("uuid").alias("target"))

    def open_count(df: DataFrame) -> int:
        return df.join(hops, [*KEYS, "target"], "left_semi").count()

    left = open_count(pointers)
    while left:
        jump = pointers.select(*KEYS, F.col("uuid").alias("target"), F.col("target").alias("_next"), F.lit(True).alias("_hit"))
        pointers = cut_lineage(
            pointers.join(jump, [*KEYS, "target"], "left").select(
                *KEYS, "uuid", F.when(F.col("_hit"), F.col("_next")).otherwise(F.col("target")).alias("target")
            )
        )
        now = open_count(pointers)
        if now == left:
            break
        left = now
    stuck = pointers.join(hops, [*KEYS, "target"], "left_semi").select(*KEYS, "uuid", F.lit(True).alias("_stuck"))
    final = pointers.join(stuck, [*KEYS, "uuid"], "left")
    targets = final.select(*KEYS, "uuid", F.when(F.col("_stuck").isNull(), F.col("target")).alias("target"))
    return targets, stuck.select(*KEYS, "uuid")


