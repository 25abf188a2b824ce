"""Reports and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import values as V
from ..functions.let import first_of
from ..functions.paths import filters_off
from ..functions.text import brief_reason, counted, short, short_count, size_words
from .touches import KEYS


def left_out(brief: DataFrame, skipped: DataFrame) -> DataFrame:
    """``why, thing, n``: one per withheld call, plus skipped files not yet listed, once each (A2)."""
    calls = (
        brief.groupBy(*KEYS, brief_reason(F.col("reason")).alias("why"), "thing")
        .agg(F.count("*").cast("bigint").alias("n"))
    )
    things = (
        skipped.where(~F.contains("what", F.lit(": ")) & ~F.startswith("what", F.lit("attachment")))
        .select(*KEYS, brief_reason(F.col("reason")).alias("why"), F.col("what").alias("thing"))
        .distinct()
        .join(calls, [*KEYS, "why", "thing"], "left_anti")
        .withColumn("n", F.lit(1).cast("bigint"))
    )
    return calls.unionByName(things)


def left_out_totals(left: DataFrame) -> DataFrame:
    """Totals by reason and overall: ``why`` is null in the overall row (A3), with the order secrets
    first, then by count (O4)."""
    return (
        left.rollup(*KEYS, "why")
        .agg(F.sum("n").cast("bigint").alias("total"), F.grouping_id().alias("_level"))
        .where(F.col("_level").isin(0, 1))
        .drop("_level")
    )


def reason_order(why: Column, total: Column) -> list[Column]:
    return [(why != "secrets").asc(), total.desc(), why.asc()]


def things_by_reason(skipped: DataFrame) -> DataFrame:
    """Per reason: how many things, and the first three of them in words.

    The rank limit is applied on both sides of the shuffle, so no list grows with the data.
    """
    rank = F.row_number().over(Window.partitionBy(*KEYS, "reason").orderBy("what"))
    firsts = (
        skipped.withColumn("_rank", rank)
        .where(F.col("_rank") <= 3)
        .groupBy(*KEYS, "reason")
        .agg(F.array_sort(F.collect_list("what")).alias("_firsts"))
    )
    counts = skipped.groupBy(*KEYS, "reason").agg(F.count("*").cast("bigint").alias("n"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(", +"), (F.col("n") - 3).cast("string"))).otherwise("")
    listed = F.concat(F.array_join(F.transform("_firsts", lambda w: short(w, 48)), ", "), more)
    return counts.join(firsts, [*KEYS, "reason"]).select(*KEYS, "reason", "n", listed.alias("listed"))


def shared_totals(shared: DataFrame) -> DataFrame:
    """Shared files: count, bytes, redacted files, redactions, steering files."""
    return shared.groupBy(*KEYS).agg(
        F.count("*").cast("bigint").alias("files"),
        F.sum("bytes").cast("bigint").alias("bytes"),
        F.count_if(F.col("redactions") > 0).cast("bigint").alias("redacted_files"),
        F.sum("redactions").cast("bigint").alias("redactions"),
        F.count_if(F.col("steers") == "instruction").cast("bigint").alias("instruction_files"),
        F.count_if(F.col("steers") == "skill").cast("bigint").alias("skill_files"),
    )


def oversize(left: DataFrame, files: DataFrame) -> DataFrame:
    """Files over the size limit that were held back: how many and how large together."""
    return (
        left.where(F.col("why") == "over 10 MB")
        .join(files.select("project_id", F.col("rel").alias("thing"), "size"), ["project_id", "thing"])
        .groupBy(*KEYS)
        .agg(F.count("*").cast("bigint").alias("files"), F.sum("size").cast("bigint").alias("bytes"))
    )


def manifests(
    sessions: DataFrame,
    facts: DataFrame,
    messages: DataFrame,
    tokens: DataFrame,
    shared: DataFrame,
    servers: DataFrame,
    excluded: DataFrame | None = None,
) -> DataFrame:
    """One manifest record per session (A17, S12). Lists hold names of steering files and servers only."""
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("steers") == kind, F.col("rel"))))
    steering = shared.where(F.col("steers").isNotNull()).groupBy(*KEYS).agg(
        names("instruction").alias("instructions"), names("skill").alias("skills")
    )
    mcp = servers.groupBy(*KEYS).agg(F.array_sort(F.collect_set("server")).alias("mcp_servers"))
    none = F.array().cast("array<string>")
    out = (
        sessions.join(facts.select(*KEYS, "agent_version"), KEYS, "left")
        .join(messages, KEYS, "left")
        .join(tokens.select(*KEYS, "tokens"), KEYS, "left")
        .join(steering, KEYS, "left")
        .join(mcp, KEYS, "left")
    )
    if excluded is not None:
        left = excluded.groupBy("project_id").agg(F.count("*").cast("bigint").alias("_left"))
        out = out.join(left, "project_id", "left")
    else:
        out = out.withColumn("_left", F.lit(None).cast("bigint"))
    return out.select(
        *KEYS,
        F.lit(2).alias("format"),
        "agent",
        "agent_version",
        F.substring_index("root", "/", -1).alias("name"),
        F.col("session_id").alias("session"),
        F.coalesce("messages", F.lit(0)).cast("bigint").alias("messages"),
        F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce("instructions", none).alias("instructions"),
        F.coalesce("skills", none).alias("skills"),
        filters_off(F.col("off")).alias("filters_off"),
        F.coalesce("mcp_servers", none).alias("mcp_servers"),
        F.coalesce("_left", F.lit(0)).alias("files_left_out_by_sender"),
    )


def summary_line(files: Column, bytes_: Column, messages: Column, tokens: Column) -> Column:
    """``2 files (3 KB) · 79 messages · ~42k tokens``."""
    return F.concat(
        counted(files, "file"), F.lit(" ("), size_words(bytes_), F.lit(") · "), counted(messages, "message"),
        F.lit(" · ~"), short_count(tokens), F.lit(" tokens"),
    )


def left_out_items(left: DataFrame) -> DataFrame:
    """Each left-out row in words, in report order (secrets first)."""
    why, thing, n = F.col("why"), F.col("thing"), F.col("n")
    item = first_of(
        (thing == V.CONNECTED, counted(n, "connected tool result")),
        (thing == V.COMMAND, F.concat(counted(n, V.COMMAND), F.lit(" ("), why, F.lit(")"))),
        (thing == V.CONTEXT, F.concat(counted(n, V.CONTEXT), F.lit(" ("), why, F.lit(")"))),
    ).otherwise(F.concat(short(thing, 60), F.lit(" ("), why, F.lit(")")))
    return left.select(*KEYS, "why", "thing", "n", item.alias("item"))
