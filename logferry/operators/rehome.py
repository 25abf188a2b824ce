"""Received logs made ready to resume in a new folder (K11; P3, P4, H9, H24, P18, W8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import values as V
from ..functions.jsontext import json_string, members_at, names_key, replace_in_strings, set_members, text_at
from ..functions.paths import normalize, path_of_url, under, url_path
from ..functions.text import stable_uuid
from .clean import dropped_attachment
from .touches import KEYS


def accepted_a(lines: DataFrame) -> DataFrame:
    """Agent A's received entries of known types, permission fields removed."""
    v = F.col("v")
    ok = F.coalesce(text_at(v, "$.type").isin(*V.A_ACCEPTED), F.lit(False)) & ~dropped_attachment(v)
    top = F.map_filter(members_at(v, "$"), lambda k, _: ~k.isin("permissionMode", "mode"))
    message = F.to_json(F.map_filter(members_at(v, "$.message"), lambda k, _: ~k.isin("permissionMode", "mode")))
    edited = F.to_json(set_members(top, {"message": message}))
    private = names_key(F.col("raw"), [members_at(v, "$"), members_at(v, "$.message")], ["permissionMode", "mode"])
    return lines.where((F.col("agent") == V.AGENT_A) & ok).withColumn(
        "raw", F.when(private, F.coalesce(edited, F.col("raw"))).otherwise(F.col("raw"))
    )


def accepted_b(lines: DataFrame) -> DataFrame:
    """Agent B's received records of known types, developer messages and private fields out."""
    v = F.col("v")
    developer = (
        (text_at(v, "$.type") == "response_item")
        & (text_at(v, "$.payload.type") == "message")
        & (text_at(v, "$.payload.role") == "developer")
    )
    ok = F.coalesce(text_at(v, "$.type").isin(*V.B_ACCEPTED), F.lit(False)) & ~F.coalesce(developer, F.lit(False))
    payload = F.to_json(F.map_filter(members_at(v, "$.payload"), lambda k, _: ~k.isin(*V.B_PRIVATE)))
    edited = F.to_json(set_members(members_at(v, "$"), {"payload": payload}))
    private = names_key(F.col("raw"), [members_at(v, "$.payload")], V.B_PRIVATE)
    return lines.where((F.col("agent") == V.AGENT_B) & ok).withColumn(
        "raw", F.when(private, F.coalesce(edited, F.col("raw"))).otherwise(F.col("raw"))
    )


def _parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.try_parse_json("raw"))


def rehome_a(lines: DataFrame) -> DataFrame:
    """Agent A's log for ``folder`` (a column): placeholder replaced, a new session id, and a working
    folder inside it whatever the sender says."""
    folder = F.col("folder")
    new_id = stable_uuid(F.lit("rehome-a"), F.col("project_id"), F.col("session_id"), folder)
    rows = accepted_a(lines).withColumn("raw", replace_in_strings(F.col("raw"), F.lit(V.ROOT), folder))
    rows = _parsed(rows).withColumn("new_id", new_id)
    v = F.col("v")
    cwd = text_at(v, "$.cwd")
    away = F.coalesce(~under(normalize(cwd), folder), F.lit(False))
    has_id = names_key(F.col("raw"), [members_at(v, "$")], ["sessionId", "session_id"])
    edited = F.to_json(
        set_members(
            members_at(v, "$"),
            {
                "sessionId": json_string(F.col("new_id")),
                "session_id": json_string(F.col("new_id")),
                "cwd": F.when(away, json_string(folder)),
            },
        )
    )
    return rows.select(
        *KEYS, "agent", "new_id", "line_no", F.when(has_id | away, edited).otherwise(F.col("raw")).alias("raw")
    )


def rehome_b(lines: DataFrame, note: str, now: str) -> DataFrame:
    """Agent B's log for ``folder``: as for A, with percent-encoded spellings inside URLs, workspace roots
    set, and the note appended as a developer message numbered after the last record (W8).

    Sessions without a ``session_meta`` record cannot be resumed and are left out.
    """
    folder = F.col("folder")
    rows = accepted_b(lines)
    is_meta = text_at(F.col("v"), "$.type") == "session_meta"
    old_id = text_at(F.col("v"), "$.payload.id")
    # The last session_meta decides which id is the old one; without an id there is none.
    olds = (
        rows.where(is_meta)
        .groupBy(*KEYS)
        .agg(F.max_by(F.struct(old_id.alias("id")), "line_no").alias("_m"))
        .select(*KEYS, F.col("_m.id").alias("old_id"))
        .where(F.col("old_id").isNotNull())
    )
    new_id = stable_uuid(F.lit("rehome-b"), F.col("project_id"), F.col("session_id"), folder)
    rows = rows.join(olds, KEYS).withColumn("new_id", new_id)
    for find, put in [
        (F.lit(f"file://{V.ROOT}"), F.concat(F.lit("file://"), url_path(folder))),
        (F.lit(V.ROOT_URL), url_path(folder)),
        (F.lit(V.ROOT), folder),
        (F.col("old_id"), F.col("new_id")),
    ]:
        rows = rows.withColumn("raw", replace_in_strings(F.col("raw"), find, put))
    rows = _parsed(rows)
    v = F.col("v")
    cwd = text_at(v, "$.payload.cwd")
    away = F.coalesce(~under(normalize(path_of_url(cwd)), folder), F.lit(False))
    roots = F.to_json(F.array(folder))
    payload = F.to_json(
        set_members(
            members_at(v, "$.payload"),
            {
                "cwd": F.when(away, json_string(folder)),
                "workspace_roots": roots,
                "runtime_workspace_roots": roots,
            },
        )
    )
    edited = F.to_json(set_members(members_at(v, "$"), {"payload": payload}))
    changed = away | F.rlike("raw", F.lit('"(?:runtime_)?workspace_roots"'))
    body = rows.select(
        *KEYS, "agent", "new_id", "line_no", F.when(changed, F.coalesce(edited, F.col("raw"))).otherwise(F.col("raw")).alias("raw")
    )
    ordinal = F.try_variant_get(v, "$.ordinal", "bigint")
    last = rows.groupBy(*KEYS, "agent", "new_id").agg(
        F.max("line_no").alias("_line"),
        F.coalesce(F.max_by(ordinal, F.when(ordinal.isNotNull(), F.col("line_no"))), F.lit(0)).alias("_ordinal"),
    )
    told = F.to_json(
        F.struct(
            F.lit("message").alias("type"),
            F.lit("developer").alias("role"),
            F.array(F.struct(F.lit("input_text").alias("type"), F.lit(note).alias("text"))).alias("content"),
        )
    )
    tail = last.select(
        *KEYS,
        "agent",
        "new_id",
        (F.col("_line") + 1).alias("line_no"),
        F.concat(
            F.lit('{"ordinal":'), (F.col("_ordinal") + 1).cast("string"), F.lit(',"payload":'), told,
            F.lit(f',"timestamp":"{now}","type":"response_item"}}'),
        ).alias("raw"),
    )
    return body.unionByName(tail)


def rehome(lines: DataFrame, folders: DataFrame, note: str, now: str) -> DataFrame:
    """Both agents' received lines (keys, agent, line_no, raw) for each session's ``folder``."""
    rows = _parsed(lines.select(*KEYS, "agent", "line_no", "raw").join(folders.select(*KEYS, "folder"), KEYS))
    return rehome_a(rows).unionByName(rehome_b(rows, note, now))


def neutral_at(neutral: DataFrame, folders: DataFrame) -> DataFrame:
    """A received neutral conversation with the placeholders replaced by each session's folder."""
    rows = neutral.join(folders.select(*KEYS, "folder"), KEYS)
    put = lambda c: F.replace(
        F.replace(c, F.lit(V.ROOT_URL), url_path(F.col("folder"))), F.lit(V.ROOT), F.col("folder")
    )
    for c in ("text", "content", "name"):
        rows = rows.withColumn(c, put(F.col(c)))
    for find, new in [(F.lit(V.ROOT_URL), url_path(F.col("folder"))), (F.lit(V.ROOT), F.col("folder"))]:
        rows = rows.withColumn("input", F.when(F.col("input").isNotNull(), replace_in_strings(F.col("input"), find, new)))
    return rows.drop("folder")
