"""Scrubbed text, estimates, manifests, totals and skills."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logferry.functions import values as V
from logferry.operators import bundles as K
from logferry.operators import neutral as N
from logferry.operators import reports as R
from logferry.operators import scrub as S
from logferry.operators.touches import connected_servers
from logferry.sources.sessions import session_facts

from . import events as E
from .registry import Tables, query

KEYS = ["project_id", "session_id"]

SAID = "text || ' Zoe Quill, zoe quill: /work/my app/x file:///work/my%20app/y /home/zoe/z; cat /home/dev/n dev zoe_key_77 zoe_key_7' || CAST(turn AS STRING)"
_REPLACED = (
    "replace(replace(replace(said, '/work/my app', '{{POD_ROOT}}'), '/work/my%20app', '{{POD_ROOT_URL}}'), '/home/zoe', '~')"
)
_NAME = r"(?i)(^|[^a-z]|%2f)Zoe Quill([^a-z]|$)"
_DEV = r"(?i)(/Users/|/home/|\\Users\\|-Users-|-home-|%2FUsers%2F|%2Fhome%2F)dev([^a-z0-9]|$)"
_named = lambda x: rf"regexp_replace(regexp_replace({x}, '{_NAME}', '\1[name]\2', 'g'), '{_NAME}', '\1[name]\2', 'g')"
_deved = lambda x: rf"regexp_replace(regexp_replace({x}, '{_DEV}', '\1user\2', 'g'), '{_DEV}', '\1user\2', 'g')"
_echoed = lambda x: f"replace(replace({x}, 'zoe_key_77', '[REDACTED:repeated]'), 'zoe_key_7', '[REDACTED:repeated]')"


@query(
    f"WITH s AS (SELECT conv_id, turn, {SAID.replace('STRING', 'VARCHAR')} AS said FROM conversations), "
    f"p AS (SELECT conv_id, turn, {_deved(_named(_REPLACED))} AS t FROM s) "
    f"SELECT conv_id, turn, {_echoed('t')} AS text, CAST(2 AS BIGINT) AS secrets FROM p"
)
def scrubbed_text(t: Tables) -> DataFrame:
    sessions = t.conversations.select(
        F.lit("p").alias("project_id"), F.col("conv_id").cast("string").alias("session_id"), F.lit("/work/my app").alias("root"),
        F.lit("/home/zoe").alias("home"), F.array().cast("array<string>").alias("off"),
    ).distinct()
    identity = t.spark.sql(
        "SELECT 'p' AS project_id, * FROM VALUES (0, 'Zoe Quill', '[name]'), (1, 'dev', 'user') AS t(position, word, replacement)"
    )
    echoes = sessions.select(*KEYS, F.explode(F.array(F.lit("zoe_key_7"), F.lit("zoe_key_77"))).alias("value"))
    ctx = S.scrub_context(sessions, identity, echoes)
    rows = t.conversations.select(
        F.lit("p").alias("project_id"), F.col("conv_id").cast("string").alias("session_id"), "conv_id", "turn", F.expr(SAID).alias("said")
    ).join(ctx.rows, KEYS)
    done = rows.select("conv_id", "turn", S.scrubbed_text("said").alias("s"))
    return done.select("conv_id", "turn", F.col("s.text").alias("text"), F.col("s.secrets").alias("secrets"))


BYTES = (
    "sum(CASE k WHEN 'view' THEN strlen(cid) + strlen(tool) + strlen(file) WHEN 'click' THEN strlen(cid) + strlen(tool) + strlen(cmd) "
    "WHEN 'purchase' THEN strlen(shown) + coalesce(strlen('c' || CAST(running % 13 AS VARCHAR)), 0) "
    "WHEN 'signup' THEN strlen('please ' || event_id) ELSE 0 END)"
)


@query(
    f"WITH {E.SQL_EV} SELECT s AS session_id, CAST({BYTES} AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS images, CAST({BYTES} * 10 // 22 AS BIGINT) AS tokens FROM ev GROUP BY 1"
)
def log_tokens(t: Tables) -> DataFrame:
    return N.estimate_tokens(E.lines_a(t)).select("session_id", "bytes", "images", "tokens")


@query(
    f"""WITH {E.SQL_EV}, m AS (SELECT s, count(*) FILTER (k = 'signup') AS messages, CAST({BYTES} * 10 // 22 AS BIGINT) AS tokens,
      list_sort(list(DISTINCT 's' || CAST(event_id % 4 AS VARCHAR)) FILTER (k = 'click' AND event_id % 10 = 0)) AS servers FROM ev GROUP BY 1)
    SELECT s AS session_id, '{V.AGENT_A}' AS agent, 'app' AS name, CAST(messages AS BIGINT) AS messages, tokens,
    CASE WHEN CAST(s AS BIGINT) % 7 = 0 THEN ['unchecked-commands', 'connected-tools'] ELSE CAST([] AS VARCHAR[]) END AS filters_off,
    coalesce(servers, CAST([] AS VARCHAR[])) AS mcp_servers, ['CLAUDE.md'] AS instructions FROM m"""
)
def session_manifests(t: Tables) -> DataFrame:
    lines, sessions = E.lines_a(t), E.sessions(t)
    messages = (
        N.to_neutral(lines).where(F.col("type") == "text").groupBy(*KEYS).agg(F.count("*").alias("messages"))
    )
    shared = sessions.select(*KEYS, F.lit("CLAUDE.md").alias("rel"), F.lit("instruction").alias("steers"))
    out = R.manifests(
        sessions, session_facts(lines), messages, N.estimate_tokens(lines), shared, connected_servers(lines)
    )
    return out.select("session_id", "agent", "name", "messages", "tokens", "filters_off", "mcp_servers", "instructions")


@query(
    "SELECT CAST(l_suppkey AS VARCHAR) AS session_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(l_orderkey) AS BIGINT) AS bytes, "
    "CAST(count(*) FILTER (l_linenumber % 3 > 0) AS BIGINT) AS redacted_files, CAST(sum(l_linenumber % 3) AS BIGINT) AS redactions, "
    "CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS instruction_files, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS skill_files "
    "FROM lineitem GROUP BY 1"
)
def shared_totals(t: Tables) -> DataFrame:
    shared = t.lineitem.select(
        F.lit("p").alias("project_id"), F.col("l_suppkey").cast("string").alias("session_id"), F.col("l_orderkey").alias("bytes"),
        (F.col("l_linenumber") % 3).alias("redactions"),
        F.when(F.col("l_returnflag") == "A", "instruction").when(F.col("l_returnflag") == "N", "skill").alias("steers"),
    )
    return R.shared_totals(shared).drop("project_id")


_HEAD = "'---' || chr(10) || 'name: d' || CAST(doc_id AS STRING) || chr(10)"
_GRANT = "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'allowed-tools: Bash' || chr(10) ELSE 'Allowed_Tools:' || chr(10) || '  - Bash' || chr(10) || chr(10) || chr(9) || '- Write' || chr(10) END"
_TAIL = "'description: z' || chr(10) || '---' || chr(10) || text"


@query(
    "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN text ELSE "
    f"{_HEAD.replace('STRING', 'VARCHAR')} || {_TAIL} END AS text FROM documents"
)
def skill_grants(t: Tables) -> DataFrame:
    skill = F.expr(f"CASE WHEN doc_id % 4 = 3 THEN text ELSE {_HEAD} || {_GRANT} || {_TAIL} END")
    return t.documents.select("doc_id", K.without_grants(skill).alias("text"))
