"""The receiver's job: audited bundles to logs the chosen agent can resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.let import first_of
from ..functions.text import plain
from ..operators.neutral import estimate_tokens, size_warning
from ..operators.rehome import neutral_at, rehome
from ..operators.touches import KEYS
from ..operators.turns import log_a, log_b, to_turns, turn_tokens


def clean_servers(names: Column) -> Column:
    """Connected-tool names from a manifest, reduced to characters that cannot say anything else."""
    kept = F.transform(names, lambda n: F.left(F.regexp_replace(plain(n), "[^A-Za-z0-9_.-]", ""), F.lit(60)))
    return F.filter(kept, lambda n: n != "")


def resume_note(servers: Column) -> Column:
    """What the resumed agent is told."""
    tools = F.concat(
        F.lit(
            V.RESUME_NOTE + " The sender's agent also had these connected tools (MCP), which may not be set up here: "
        ),
        F.array_join(servers, ", "),
        F.lit(". If a step needs one that isn't available, say so rather than guessing its result."),
    )
    return F.when(F.size(servers) > 0, tools).otherwise(V.RESUME_NOTE)


def received_summary(manifest: DataFrame, lines: DataFrame, neutral: DataFrame, target: str) -> DataFrame:
    """One row per received session: tokens recounted from what arrived, steering files, tools, filters off."""
    native = estimate_tokens(lines).select(*KEYS, F.col("tokens").alias("_native"))
    turns = to_turns(neutral, manifest.select(*KEYS, "agent"))
    carried = turn_tokens(turns, target).select(*KEYS, F.col("tokens").alias("_carried"))
    moved = F.col("agent") != target
    listed = lambda c: F.transform(c, plain)
    rows = manifest.join(native, KEYS, "left").join(carried, KEYS, "left")
    tokens = F.coalesce(F.when(moved, F.col("_carried")).otherwise(F.col("_native")), F.lit(0)).cast("bigint")
    servers = clean_servers(F.col("mcp_servers"))
    return rows.select(
        *KEYS,
        "agent",
        F.lit(target).alias("target"),
        moved.alias("carried"),
        tokens.alias("tokens"),
        size_warning(tokens).alias("warning"),
        F.concat(listed(F.col("instructions")), listed(F.col("skills"))).alias("steering"),
        servers.alias("mcp_servers"),
        listed(F.col("filters_off")).alias("filters_off"),
        resume_note(servers).alias("note"),
    )


def open_sessions(
    lines: DataFrame, neutral: DataFrame, folders: DataFrame, target: str, now: str, now_seconds: int, note: str = V.RESUME_NOTE
) -> DataFrame:
    """``keys, agent, new_id, line_no, raw``: each received session as a log of ``target`` in its folder.

    Sessions of that agent are rehomed; the others are carried over as turns. ``folders``: keys, agent, folder.
    """
    same = folders.where(F.col("agent") == target)
    other = folders.where(F.col("agent") != target)
    own = rehome(lines, same, note, now)
    at = neutral_at(neutral.join(other.select(*KEYS), KEYS, "left_semi"), other)
    turns = to_turns(at, other)
    placeholder = "{{LOG_FOLDER}}"
    built = log_a(turns, placeholder, now) if target == V.AGENT_A else log_b(turns, placeholder, now, now_seconds, note)
    # The folder differs per session: it goes in as JSON text once the record is built.
    escaped = F.regexp_extract(F.to_json(F.array(F.col("folder"))), r'(?s)^\["(.*)"\]\z', 1)
    built = built.join(other.select(*KEYS, "folder"), KEYS).withColumn(
        "raw", F.replace("raw", F.lit(placeholder), escaped)
    )
    cols = [*KEYS, "agent", "new_id", "line_no", "raw"]
    return own.select(*cols).unionByName(built.select(*cols))


def install_folder(agent: Column, folder: Column, new_id: Column, now: str) -> Column:
    """Where a log belongs under its agent's home."""
    from ..functions.paths import encoded_folder

    day, clock = now[:10], now[11:19].replace(":", "-")
    b = F.concat(F.lit(f"sessions/{day.replace('-', '/')}/rollout-{day}T{clock}-"), new_id, F.lit(".jsonl"))
    a = F.concat(F.lit("projects/"), encoded_folder(folder), F.lit("/"), new_id, F.lit(".jsonl"))
    return first_of((agent == V.AGENT_B, b)).otherwise(a)
