"""Conversations as session logs of both agents: reading, neutral form, turns, rebuilt logs, estimates
(K7-K11, K15, K18; W1, W4, W7-W10, A5-A7, H12-H15, U3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logferry.functions import values as V
from logferry.functions.jsontext import text_at
from logferry.functions.text import utc_time
from logferry.operators import neutral as N
from logferry.operators import ordered
from logferry.operators import rehome as R
from logferry.operators import turns as U
from logferry.plans import catalog as C
from logferry.plans import receive as G

from . import sqltext as X
from .registry import Tables, query

KEYS = ["project_id", "session_id"]
NOW = "2026-01-01T00:00:00.000Z"
q = X.quote

AGENT = f"CASE WHEN conv_id % 2 = 0 THEN '{V.AGENT_A}' ELSE '{V.AGENT_B}' END"


def sessions(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.lit("p").alias("project_id"), F.col("conv_id").cast("string").alias("session_id"), F.expr(AGENT).alias("agent")
    ).distinct()


def lines(t: Tables) -> DataFrame:
    """Each conversation as a log: even ones of agent A, odd ones of agent B, serialised and parsed again."""
    text, role = F.col("text"), F.col("role")
    a = F.when(role == "system", F.to_json(F.struct(F.lit("summary").alias("type"), text.alias("summary")))).otherwise(
        F.to_json(
            F.struct(
                role.alias("type"),
                F.concat(F.lit("u"), F.col("turn")).alias("uuid"),
                F.lit(f"{V.ROOT}/src").alias("cwd"),
                F.lit("old").alias("sessionId"),
                F.lit("ask").alias("permissionMode"),
                F.struct(
                    role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")
                ).alias("message"),
            )
        )
    )
    # A prompt is plain text where the turn is even, a list of parts where it is odd.
    a = F.when(
        (role == "user") & (F.col("turn") % 2 == 0),
        F.to_json(
            F.struct(
                role.alias("type"),
                F.concat(F.lit("u"), F.col("turn")).alias("uuid"),
                F.lit(f"{V.ROOT}/src").alias("cwd"),
                F.lit("old").alias("sessionId"),
                F.lit("ask").alias("permissionMode"),
                F.struct(role.alias("role"), text.alias("content")).alias("message"),
            )
        ),
    ).otherwise(a)
    message = F.struct(
        F.lit("message").alias("type"),
        role.alias("role"),
        F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"))).alias("content"),
    )
    ordinal = (F.col("turn") + 1).alias("ordinal")
    b = F.when(
        role == "system",
        F.to_json(F.struct(F.lit("compacted").alias("type"), F.struct(text.alias("message")).alias("payload"), ordinal)),
    ).otherwise(F.to_json(F.struct(F.lit("response_item").alias("type"), message.alias("payload"), ordinal)))
    said = t.conversations.select(
        F.lit("p").alias("project_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.expr(AGENT).alias("agent"),
        (F.col("turn") + 1).alias("line_no"),
        F.when(F.col("conv_id") % 2 == 0, a).otherwise(b).alias("raw"),
    )
    meta = F.to_json(
        F.struct(
            F.lit("session_meta").alias("type"),
            F.struct(
                F.concat(F.lit("id-"), F.col("session_id")).alias("id"),
                F.lit(f"file://{V.ROOT}").alias("cwd"),
                F.lit("0.1").alias("cli_version"),
                F.lit("u").alias("creator_user_id"),
            ).alias("payload"),
            F.lit(0).alias("ordinal"),
        )
    )
    heads = sessions(t).where(F.col("agent") == V.AGENT_B).select(
        *KEYS, "agent", F.lit(0).cast("bigint").alias("line_no"), meta.alias("raw")
    )
    return said.unionByName(heads).withColumn("v", F.try_parse_json("raw"))


# What each side says, by the rules of the neutral form: agent B starts at its last summary.
SPOKEN = f"""
cut AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN turn END) AS cut FROM conversations GROUP BY 1),
seen AS (SELECT c.*, {AGENT} AS agent FROM conversations c JOIN cut USING (conv_id)
         WHERE conv_id % 2 = 0 OR cut IS NULL OR turn >= cut),
neutral AS (SELECT conv_id, turn, agent, CASE WHEN role = 'system' THEN NULL ELSE role END AS role,
            CASE WHEN role = 'system' THEN 'summary' ELSE 'text' END AS type, text FROM seen
            WHERE NOT (role = 'system' AND conv_id % 2 = 1 AND text = ''))"""

MERGED = f"""{SPOKEN},
spoken AS (SELECT conv_id, turn, agent, type = 'summary' OR role = 'user' AS u,
           CASE WHEN type = 'summary' THEN {q(V.SUMMARY_HEAD)} || chr(10) || text ELSE text END AS text FROM neutral
           WHERE regexp_matches(text, '\\S') OR type = 'summary'),
flags AS (SELECT *, CASE WHEN lag(u) OVER w IS DISTINCT FROM u THEN 1 ELSE 0 END AS start FROM spoken WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
isl AS (SELECT *, sum(start) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM flags),
merged AS (SELECT conv_id, agent, island, any_value(u) AS u, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM isl GROUP BY ALL),
label AS (SELECT DISTINCT conv_id, agent, CASE WHEN agent = '{V.AGENT_A}' THEN {q(V.LABELS[V.AGENT_A])} ELSE {q(V.LABELS[V.AGENT_B])} END AS l FROM (SELECT conv_id, {AGENT} AS agent FROM conversations)),
intro AS (SELECT conv_id, {q(V.INTRO_START)} || l || ' and was moved here with {V.TOOL}. ' || l || '''s tool calls appear as text lines (▸ …) ' || {q(V.INTRO_END)} AS intro FROM label),
ends AS (SELECT conv_id, min(island) AS f, max(island) AS z, arg_min(u, island) AS fu, arg_max(u, island) AS zu FROM merged GROUP BY 1),
turns0 AS (
  SELECT m.conv_id, island AS o, u, CASE WHEN island = f AND u THEN intro || chr(10) || chr(10) || text ELSE text END AS text
  FROM merged m JOIN ends USING (conv_id) JOIN intro USING (conv_id)
  UNION ALL SELECT i.conv_id, -1, true, intro FROM intro i LEFT JOIN ends USING (conv_id) WHERE fu IS NULL OR NOT fu
  UNION ALL SELECT i.conv_id, 1000000000, false, {q(V.PICKED_UP)} FROM intro i LEFT JOIN ends USING (conv_id) WHERE zu IS NULL OR zu),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS turn_no, u, text FROM turns0)"""


@query(f"WITH {SPOKEN} SELECT CAST(conv_id AS VARCHAR) AS session_id, agent, turn, role, type, text FROM neutral")
def neutral_messages(t: Tables) -> DataFrame:
    n = N.to_neutral(lines(t))
    return n.select("session_id", "agent", (F.shiftright("seq", 31) - 1).alias("turn"), "role", "type", "text")


@query(f"WITH {MERGED} SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn_no AS BIGINT) AS turn_no, u AS user, text FROM turns")
def carried_turns(t: Tables) -> DataFrame:
    return U.to_turns(N.to_neutral(lines(t)), sessions(t)).drop("project_id")


@query(
    f"WITH {MERGED} SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(sum(strlen(text)) AS BIGINT) AS bytes, "
    "CAST(sum(strlen(text)) * 10 // 33 AS BIGINT) AS tokens FROM turns GROUP BY 1"
)
def carried_tokens(t: Tables) -> DataFrame:
    return U.turn_tokens(U.to_turns(N.to_neutral(lines(t)), sessions(t)), V.AGENT_B).drop("project_id")


@query(
    f"""WITH {SPOKEN}, b AS (SELECT conv_id, sum(CASE WHEN conv_id % 2 = 0 THEN CASE WHEN role IS NULL THEN 0 ELSE strlen(text) END
        ELSE strlen(text) + coalesce(strlen(role), 0) END) AS bytes FROM seen2 GROUP BY 1)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes,
    CAST(coalesce(bytes, 0) * 10 // CASE WHEN conv_id % 2 = 0 THEN 22 ELSE 33 END AS BIGINT) AS tokens FROM b""".replace(
        "b AS (SELECT", "seen2 AS (SELECT conv_id, CASE WHEN role = 'system' THEN NULL ELSE role END AS role, text FROM seen), b AS (SELECT", 1
    )
)
def session_tokens(t: Tables) -> DataFrame:
    return N.estimate_tokens(lines(t)).select("session_id", "bytes", "tokens")


@query(f"WITH {SPOKEN} SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(count(*) AS BIGINT) AS messages FROM neutral WHERE type = 'text' GROUP BY 1")
def message_counts(t: Tables) -> DataFrame:
    n = N.to_neutral(lines(t)).where(F.col("type") == "text")
    return n.groupBy("session_id").agg(F.count("*").alias("messages"))


@query(
    """WITH m AS (SELECT *, CASE WHEN role = 'system' THEN 'user' ELSE role END AS side FROM conversations WHERE regexp_matches(text, '\\S')),
    f AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM side THEN 1 ELSE 0 END AS s FROM m),
    i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f)
    SELECT conv_id, min(turn) AS turn, any_value(side) AS side, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island"""
)
def merged_turns(t: Tables) -> DataFrame:
    rows = t.conversations.where(F.rlike("text", F.lit(r"\S"))).withColumn(
        "side", F.when(F.col("role") == "system", "user").otherwise(F.col("role"))
    )
    return ordered.merge_neighbours(rows, ["conv_id"], "turn", "side", "text", "\n\n")


@query(
    r"""WITH u AS (SELECT conv_id, arg_min(text, turn) FILTER (text <> '' AND NOT starts_with(text, '<')) AS first FROM conversations WHERE role = 'user' GROUP BY 1),
    s AS (SELECT DISTINCT conv_id FROM conversations),
    o AS (SELECT s.conv_id, CASE WHEN s.conv_id % 2 = 0 THEN first ELSE coalesce(first, '(untitled)') END AS t FROM s LEFT JOIN u USING (conv_id)),
    c AS (SELECT conv_id, regexp_replace(regexp_replace(t, '[\x00-\x1f\x7f]', '?', 'g'), '^\s+|\s+$', '', 'g') AS t FROM o WHERE t IS NOT NULL),
    w AS (SELECT conv_id, regexp_replace(t, '\s+', ' ', 'g') AS t FROM c)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN conv_id % 2 = 0 THEN 'Claude Code' ELSE 'Codex' END AS label,
    CASE WHEN length(t) > 70 THEN left(t, 70) || '…' ELSE t END AS title FROM w"""
)
def session_titles(t: Tables) -> DataFrame:
    at = lines(t).withColumn("modified", F.timestamp_seconds(F.col("line_no") + F.col("session_id").cast("bigint") * 100))
    return C.described(C.session_catalog(at), F.timestamp_seconds(F.lit(10_000_000))).select("session_id", "label", "title")


@query(
    """WITH m AS (SELECT conv_id, max(turn + 1 + conv_id * 100) AS s FROM conversations GROUP BY 1),
    a AS (SELECT conv_id, 1000000 - s AS age, s FROM m WHERE conv_id % 2 = 1 OR conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user'))
    SELECT CAST(conv_id AS VARCHAR) AS session_id,
    CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN (age // 60) || ' min ago' WHEN age < 86400 THEN (age // 3600) || ' h ago'
    WHEN age < 172800 THEN '1 day ago' WHEN age < 2592000 THEN (age // 86400) || ' days ago' ELSE 'long ago' END AS age
    FROM a ORDER BY s DESC, session_id LIMIT 20"""
)
def recent_sessions(t: Tables) -> DataFrame:
    at = lines(t).withColumn("modified", F.timestamp_seconds(F.col("line_no") + F.col("session_id").cast("bigint") * 100))
    recent = C.most_recent(C.session_catalog(at), 20)
    return C.described(recent, F.timestamp_seconds(F.lit(1_000_000))).select("session_id", "age")


def spoken_turns(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.lit("p").alias("project_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("turn_no"),
        (F.col("role") != "assistant").alias("user"),
        "text",
    )


def sql_uuid(*parts: str) -> str:
    h = f"sha256(concat_ws('␟', {', '.join(parts)}))"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"


@query(
    f"WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS s, turn FROM conversations) SELECT s AS session_id, turn AS line_no, "
    f"{sql_uuid(q('session-a'), q('p'), 's')} AS new_id, {sql_uuid(q('turn-a'), q('p'), 's', 'CAST(turn AS VARCHAR)')} AS uuid, "
    f"CASE WHEN turn > 0 THEN {sql_uuid(q('turn-a'), q('p'), 's', 'CAST(turn - 1 AS VARCHAR)')} END AS parent FROM c"
)
def parent_chain(t: Tables) -> DataFrame:
    v = F.try_parse_json("raw")
    return U.log_a(spoken_turns(t), "/new", NOW).select(
        "session_id", "line_no", text_at(v, "$.sessionId").alias("new_id"), text_at(v, "$.uuid").alias("uuid"),
        text_at(v, "$.parentUuid").alias("parent"),
    )


@query(
    "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS turn_no, "
    "max(CASE WHEN role <> 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS task_no FROM conversations"
)
def task_brackets(t: Tables) -> DataFrame:
    return U.tasks(spoken_turns(t)).select("session_id", "turn_no", "task_no")


@query(
    """WITH c AS (SELECT conv_id, turn, role <> 'assistant' AS u, text FROM conversations),
    t AS (SELECT *, last_value(CASE WHEN NOT u THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS said,
      count(*) FILTER (u) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
      max(turn) OVER (PARTITION BY conv_id) AS z, count(*) FILTER (u) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM c),
    r AS (SELECT conv_id, turn * 16 + 1 AS o, 'task_complete' AS kind, coalesce(said, '') AS text FROM t WHERE u AND before > 0
      UNION ALL SELECT conv_id, turn * 16 + 2, 'task_started', NULL FROM t WHERE u
      UNION ALL SELECT conv_id, turn * 16 + 3, 'message', text FROM t
      UNION ALL SELECT conv_id, turn * 16 + 5, 'item_completed', text FROM t
      UNION ALL SELECT conv_id, turn * 16 + 7, 'message', 'NOTE' FROM t WHERE turn = z
      UNION ALL SELECT conv_id, turn * 16 + 8, 'task_complete', CASE WHEN u THEN coalesce(said, '') ELSE text END FROM t WHERE turn = z AND upto > 0
      UNION ALL SELECT conv_id, -1, NULL, NULL FROM t WHERE turn = 0)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS BIGINT) AS ordinal, kind, text FROM r"""
)
def rebuilt_log_b(t: Tables) -> DataFrame:
    v = F.try_parse_json("raw")
    return U.log_b(spoken_turns(t), "/new", NOW, 1767225600, "NOTE").select(
        "session_id",
        F.try_variant_get(v, "$.ordinal", "bigint").alias("ordinal"),
        text_at(v, "$.payload.type").alias("kind"),
        F.coalesce(
            text_at(v, "$.payload.last_agent_message"), text_at(v, "$.payload.content[0].text"), text_at(v, "$.payload.item.content[0].text")
        ).alias("text"),
    )


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations),
    a AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS line_no, CASE WHEN role = 'system' THEN 'summary' ELSE role END AS type,
      CASE WHEN role = 'system' THEN NULL ELSE '/new place/src' END AS cwd, CASE WHEN role = 'system' THEN NULL ELSE {sql_uuid(q('rehome-a'), q('p'), 'CAST(conv_id AS VARCHAR)', q('/new place'))} END AS sid FROM c WHERE conv_id % 2 = 0),
    b AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS line_no, CASE WHEN role = 'system' THEN 'compacted' ELSE 'response_item' END AS type, NULL AS cwd, NULL AS sid FROM c WHERE conv_id % 2 = 1
      UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 0, 'session_meta', 'file:///new%20place', {sql_uuid(q('rehome-b'), q('p'), 'CAST(conv_id AS VARCHAR)', q('/new place'))} FROM c WHERE conv_id % 2 = 1
      UNION ALL SELECT CAST(conv_id AS VARCHAR), max(turn) + 2, 'response_item', NULL, NULL FROM c WHERE conv_id % 2 = 1 GROUP BY 1)
    SELECT * FROM a UNION ALL SELECT * FROM b"""
)
def rehomed_logs(t: Tables) -> DataFrame:
    folders = sessions(t).select(*KEYS, F.lit("/new place").alias("folder"))
    out = R.rehome(lines(t).drop("v"), folders, "NOTE", NOW).withColumn("v", F.try_parse_json("raw"))
    v = F.col("v")
    return out.select(
        "session_id", "line_no", text_at(v, "$.type").alias("type"),
        F.coalesce(text_at(v, "$.cwd"), text_at(v, "$.payload.cwd")).alias("cwd"),
        F.coalesce(text_at(v, "$.sessionId"), text_at(v, "$.payload.id")).alias("sid"),
    )


@query(
    f"""WITH {MERGED}, b AS (SELECT conv_id, sum(CASE WHEN role = 'system' THEN 0 ELSE strlen(text) END) AS bytes FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1),
    k AS (SELECT conv_id, sum(strlen(text)) AS bytes FROM turns WHERE conv_id % 2 = 1 GROUP BY 1)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id % 2 = 1 AS carried, CAST(bytes * 10 // 22 AS BIGINT) AS tokens,
    ['CLAUDE.md', '.claude/skills/x/SKILL.md'] AS steering, ['git_hub-1.x'] AS mcp_servers FROM (SELECT * FROM b UNION ALL SELECT * FROM k)"""
)
def received_summaries(t: Tables) -> DataFrame:
    manifest = sessions(t).select(
        *KEYS, "agent", F.array(F.lit("CLAUDE.md")).alias("instructions"), F.array(F.lit(".claude/skills/x/SKILL.md")).alias("skills"),
        F.array(F.lit("git_hub-1.x !<"), F.lit("!!")).alias("mcp_servers"), F.array().cast("array<string>").alias("filters_off"),
    )
    ls = lines(t)
    return G.received_summary(manifest, ls, N.to_neutral(ls), V.AGENT_A).select(
        "session_id", "carried", "tokens", "steering", "mcp_servers"
    )


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS at FROM events"
)
def utc_times(t: Tables) -> DataFrame:
    return t.events.select("event_id", utc_time(F.col("ts")).alias("at"))
