"""Events as agent logs: calls, results, owners, verdicts, cleaning, relinking, reports
(K1, K2, K4, K5, K13, K14 parts; J1-J8, J18, J19, W1-W3, W5, W6, A1-A4, A8, A11, O4, O5, P1, P24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logferry.functions import text as T
from logferry.functions import values as V
from logferry.functions.jsontext import text_at
from logferry.functions.paths import normalize
from logferry.operators import clean as K
from logferry.operators import judge as J
from logferry.operators import neutral as N
from logferry.operators import ordered as O
from logferry.operators import reports as R
from logferry.operators import scrub as S
from logferry.operators import touches as U
from logferry.plans import catalog as C
from logferry.plans.pack import Corpus, Plan, plan
from logferry.session import cut_lineage

from . import paths as P
from . import sqltext as X
from .lifts import COMMANDS, SUFFIXES
from .registry import Tables, query

q = X.quote
KEYS = ["project_id", "session_id"]
ROOT, HOME = "/work/app", "/home/me"

N_CMD = len(COMMANDS)
SQL_CMD = "[" + ", ".join(q(c) for c in COMMANDS) + f"][1 + CAST(event_id % {N_CMD} AS INT)]"
_spark_q = lambda c: q(c).replace("\\", "\\\\").replace("''", "\\'") if c else "''"
SPARK_CMD = "element_at(array(" + ", ".join(_spark_q(c) for c in COMMANDS) + f"), 1 + CAST(event_id % {N_CMD} AS INT))"
FILE = (
    "'/work/app/f' || CAST(event_id % 50 AS STRING) || CASE event_id % 8 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES))
    + " END"
)
CALL_ID = "'c' || CAST(event_id % 13 AS STRING)"
SHOWN = (
    "CASE event_id % 6 WHEN 0 THEN 'shown: ~/.ssh/id_rsa' WHEN 1 THEN '.env:3:KEY=abc' "
    "WHEN 2 THEN 'see' || chr(10) || 'DB_PASSWORD=' || substr(md5(CAST(event_id AS STRING)), 1, 10) ELSE 'ok ' || CAST(event_id AS STRING) END"
)
TOOL = "CASE WHEN event_type = 'view' THEN 'Read' WHEN event_id % 10 = 0 THEN 'mcp__s' || CAST(event_id % 4 AS STRING) || '!__do' ELSE 'Bash' END"

# Events with what each becomes; ``running`` is the call an output answers.
SQL_EV = f"""ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS s, event_type AS k, {CALL_ID} AS cid, {TOOL} AS tool, {FILE} AS file,
  {SQL_CMD} AS cmd, {SHOWN} AS shown,
  lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev,
  max(CASE WHEN event_type IN ('view', 'click') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running
  FROM events)"""


def events(t: Tables) -> DataFrame:
    """The events as calls and results. What came before each is worked out once, on the narrow columns that decide it."""
    e = t.events.select(
        F.lit("p").alias("project_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("line_no"),
        F.col("event_type").alias("k"),
    )
    placed = cut_lineage(
        O.carry_forward(
            e, KEYS, "line_no",
            {"prev": F.col("line_no"), "running": F.when(F.col("k").isin("view", "click"), F.col("line_no"))}, before=True,
        )
    )
    named = placed.withColumnRenamed("line_no", "event_id").withColumnRenamed("k", "event_type")
    return named.select(
        *KEYS,
        F.col("event_id").alias("line_no"),
        F.col("event_type").alias("k"),
        F.expr(CALL_ID).alias("cid"),
        F.expr(TOOL).alias("tool"),
        F.expr(FILE).alias("file"),
        F.expr(SPARK_CMD).alias("cmd"),
        F.expr(SHOWN).alias("shown"),
        "prev",
        "running",
    )


def _json(*fields) -> F.Column:
    return F.to_json(F.struct(*fields))


def lines_a(t: Tables) -> DataFrame:
    k, uuid = F.col("k"), F.concat(F.lit("e"), F.col("line_no"))
    base = [
        uuid.alias("uuid"), F.concat(F.lit("e"), F.col("prev")).alias("parentUuid"), F.lit(ROOT).alias("cwd"),
        F.lit("ask").alias("permissionMode"),
    ]
    content = lambda *b: F.struct(F.lit("assistant").alias("role"), F.array(F.struct(*b)).alias("content")).alias("message")
    call = lambda name, arg, value: _json(
        F.lit("assistant").alias("type"), *base,
        content(F.lit("tool_use").alias("type"), F.col("cid").alias("id"), name.alias("name"), F.struct(value.alias(arg)).alias("input")),
    )
    answered = F.concat(F.lit("c"), (F.col("running") % 13).cast("string"))
    result = _json(
        F.lit("user").alias("type"), *base,
        content(F.lit("tool_result").alias("type"), answered.alias("tool_use_id"), F.col("shown").alias("content")),
        F.struct(F.concat(F.lit("copy "), F.col("line_no")).alias("stdout")).alias("toolUseResult"),
    )
    prompt = _json(F.lit("user").alias("type"), *base, F.struct(F.concat(F.lit("please "), F.col("line_no")).alias("content")).alias("message"))
    raw = (
        F.when(k == "view", call(F.col("tool"), "file_path", F.col("file")))
        .when(k == "click", call(F.col("tool"), "command", F.col("cmd")))
        .when(k == "purchase", result)
        .when(k == "signup", prompt)
        .otherwise(_json(F.lit("mode").alias("type"), *base))
    )
    return events(t).select(*KEYS, F.lit(V.AGENT_A).alias("agent"), "line_no", raw.alias("raw")).withColumn("v", F.try_parse_json("raw"))


def lines_b(t: Tables) -> DataFrame:
    k = F.col("k")
    response = lambda *p: _json(F.lit("response_item").alias("type"), F.struct(*p).alias("payload"))
    cid = lambda n: F.concat(F.lit("c"), n.cast("string"))
    call = response(
        F.lit("custom_tool_call").alias("type"), cid(F.col("line_no")).alias("call_id"), F.lit("exec").alias("name"),
        F.concat(F.lit("await tools."), F.when(F.col("line_no") % 3 == 0, "web_run").otherwise("exec_command"), F.lit("({})")).alias("input"),
    )
    item = _json(
        F.lit("event_msg").alias("type"),
        F.struct(
            F.lit("item_completed").alias("type"),
            F.struct(
                F.when(F.col("line_no") % 5 == 0, "WebSearchEnd").otherwise("CommandExecution").alias("type"),
                F.array(F.lit("sh"), F.lit("-lc"), F.concat(F.lit("cat f"), F.col("line_no"))).alias("command"),
                F.concat(F.lit("out "), F.col("line_no")).alias("aggregated_output"),
            ).alias("item"),
        ).alias("payload"),
    )
    output = response(
        F.lit("custom_tool_call_output").alias("type"), F.coalesce(cid(F.col("called")), F.lit("nobody")).alias("call_id"),
        F.array(F.struct(F.lit("input_text").alias("type"), F.concat(F.lit("done "), F.col("line_no")).alias("text"))).alias("output"),
    )
    turn = _json(
        F.lit("turn_context").alias("type"),
        F.struct(F.concat(F.lit("file:///work/app/d%20"), F.col("line_no") % 3).alias("cwd"), F.lit("never").alias("approval_policy")).alias("payload"),
    )
    raw = (
        F.when(k == "click", call).when(k == "view", item).when(k == "purchase", output).when(k == "signup", turn)
        .otherwise(_json(F.lit("world_state").alias("type"), F.struct(F.lit("x").alias("state")).alias("payload")))
    )
    e = O.carry_forward(
        events(t), KEYS, "line_no",
        {"called": F.when(k == "click", F.col("line_no"))}, before=True,
    )
    return e.select(*KEYS, F.lit(V.AGENT_B).alias("agent"), "line_no", raw.alias("raw")).withColumn("v", F.try_parse_json("raw"))


def sessions(t: Tables, agent: str = V.AGENT_A) -> DataFrame:
    return t.events.select(
        F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("session_id"), F.lit(agent).alias("agent"),
        F.lit(ROOT).alias("root"), F.lit(HOME).alias("home"), F.lit(ROOT).alias("cwd"),
        F.when(F.col("user_id") % 7 == 0, F.array(F.lit("unchecked-commands"), F.lit("connected-tools"))).otherwise(F.array().cast("array<string>")).alias("off"),
    ).distinct()


# --- touches and results -----------------------------------------------------------------------


@query(
    f"WITH {SQL_EV} SELECT s AS session_id, event_id AS line_no, cid AS id, tool, CASE WHEN k = 'view' THEN file END AS file, "
    "CASE WHEN k = 'click' THEN cmd END AS command FROM ev WHERE k IN ('view', 'click')"
)
def tool_calls(t: Tables) -> DataFrame:
    touches, _ = U.touches_a(lines_a(t))
    return touches.select("session_id", F.shiftright("touch_no", 31).alias("line_no"), "id", "tool", "file", "command")


FIRST_CALLS = "first AS (SELECT s, cid, min(event_id) AS call, arg_min(k, event_id) AS ck FROM ev WHERE k IN ('view', 'click') GROUP BY 1, 2)"
RESULTS = "res AS (SELECT f.s, f.call, e.event_id AS seen_at, e.shown FROM ev e JOIN first f ON f.s = e.s AND f.cid = 'c' || CAST(e.running % 13 AS VARCHAR) WHERE e.k = 'purchase' AND f.ck = 'click')"


@query(
    f"WITH {SQL_EV}, {FIRST_CALLS}, {RESULTS} SELECT s AS session_id, call AS line_no, seen_at AS \"at\", shown AS text FROM res "
    "UNION ALL SELECT s, call, seen_at, 'copy ' || CAST(seen_at AS VARCHAR) FROM res"
)
def tool_call_results(t: Tables) -> DataFrame:
    a = lines_a(t)
    texts = U.answered(U.calls_a(a), U.results_a(a))
    return texts.select("session_id", F.shiftright("touch_no", 31).alias("line_no"), F.shiftright("ord", 31).alias("at"), "text")


@query(
    f"WITH {SQL_EV} SELECT DISTINCT s AS session_id, 's' || CAST(event_id % 4 AS VARCHAR) AS server FROM ev WHERE k = 'click' AND event_id % 10 = 0"
)
def connected_servers(t: Tables) -> DataFrame:
    return U.connected_servers(lines_a(t)).select("session_id", "server")


# --- verdicts -------------------------------------------------------------------------------------

OFF = "(CAST(e.s AS BIGINT) % 7 = 0)"
CMD_PATHS = f"""cw AS (SELECT c, cmd, unnest({P.SQL_WORDS.replace('text', 'cmd')}) AS w, generate_subscripts({P.SQL_WORDS.replace('text', 'cmd')}, 1) AS pos
    FROM (VALUES {', '.join(f'({i}, {q(c)})' for i, c in enumerate(COMMANDS))}) AS v(c, cmd)),
  cs AS (SELECT c, pos, CASE WHEN ends_with(w, '..') OR w = '.' THEN w ELSE regexp_replace(w, '[.\\\\]+$', '') END AS w FROM cw),
  cj AS (SELECT c, pos, CASE WHEN w = '~' THEN '{HOME}' WHEN starts_with(w, '~/') THEN '{HOME}/' || substr(w, 3) WHEN starts_with(w, '/') THEN w ELSE '{ROOT}/' || w END AS p FROM cs),
  cn AS (SELECT c, pos, {P.sql_normalise('p')} AS p FROM cj),
  cl AS (SELECT c, pos, p, {P.sql_off_limits('p', q(ROOT), q(HOME))} AS lim FROM cn),
  cr AS (SELECT c, arg_min(lim, pos) AS why, arg_min(p, pos) AS culprit FROM cl WHERE starts_with(lim, 'sensitive') OR (lim = 'outside the project' AND {P.sql_under('p', q(HOME))}) GROUP BY 1)"""
VERDICTS = f"""WITH {SQL_EV}, {FIRST_CALLS}, {RESULTS}, {CMD_PATHS},
  shownwhy AS (SELECT s, call, arg_min(CASE event_id6 WHEN 0 THEN 'sensitive: personal folder in the home directory' ELSE 'sensitive: environment file' END, seen_at) AS why
    FROM (SELECT *, seen_at % 6 AS event_id6 FROM res) WHERE event_id6 IN (0, 1) GROUP BY 1, 2),
  vf AS (SELECT ev.*, {P.sql_normalise('file')} AS np FROM ev WHERE k = 'view'),
  fl AS (SELECT s, event_id, cid, tool, file AS culprit, CASE WHEN starts_with(lim, 'sensitive') THEN lim WHEN event_id % 2 = 1 AND NOT has THEN
      CASE WHEN {P.sql_under('np', q(ROOT))} THEN 'no longer exists' ELSE 'outside the project' END ELSE lim END AS why
    FROM (SELECT vf.*, {P.sql_off_limits('np', q(ROOT), q(HOME))} AS lim, np IN (SELECT {P.sql_normalise('file')} FROM ev WHERE event_id % 2 = 0) AS has FROM vf)),
  ck AS (SELECT e.s, e.event_id, e.cid, e.tool, e.cmd, CASE WHEN starts_with(tool, 'mcp__') AND NOT {OFF} THEN {q(V.MCP_REASON)}
      WHEN cr.why IS NOT NULL THEN cr.why
      WHEN tool = 'Bash' AND {P.sql_sensitive('cmd')} THEN {q(V.SENSITIVE_CMD_REASON)}
      WHEN tool = 'Bash' AND NOT {OFF} AND {P.sql_opaque('cmd')} THEN {q(V.UNCHECKED_REASON)}
      ELSE sh.why END AS why, CASE WHEN starts_with(tool, 'mcp__') AND NOT {OFF} THEN NULL ELSE cr.culprit END AS culprit
    FROM ev e LEFT JOIN cr ON cr.c = e.event_id % {N_CMD} LEFT JOIN shownwhy sh ON sh.s = e.s AND sh.call = e.event_id WHERE k = 'click'),
  verdicts AS (SELECT s, event_id, cid, tool, why, culprit, NULL AS cmd, true AS is_file FROM fl WHERE why IS NOT NULL
    UNION ALL SELECT s, event_id, cid, tool, why, culprit, cmd, false FROM ck WHERE why IS NOT NULL)"""


def verdict_tables(t: Tables):
    s, a = sessions(t), lines_a(t)
    # As in a full run, the calls are written once and read by every later step.
    touches, texts = U.split_tables(cut_lineage(U.calls_a(a)), U.results_a(a))
    path = normalize(F.expr(FILE))
    files = t.events.where("event_id % 2 = 0").select(
        F.lit("p").alias("project_id"), path.alias("path"), path.alias("real_path"), F.lit(True).alias("is_file"),
        F.lit(100).cast("bigint").alias("size"), F.lit(False).alias("ignored"), F.lit(None).cast("string").alias("key_rule"),
        F.lit(None).cast("string").alias("utf16_rule"), F.lit(0).alias("redactions"),
    ).distinct()
    checked = J.checked_paths(J.named_paths(touches, texts, s), files)
    return touches, texts, s, J.judge(touches, texts, checked, s)


@query(f"{VERDICTS} SELECT s AS session_id, event_id AS line_no, why AS reason, culprit FROM verdicts")
def call_verdicts(t: Tables) -> DataFrame:
    *_, verdicts = verdict_tables(t)
    return verdicts.select("session_id", F.shiftright("touch_no", 31).alias("line_no"), "reason", "culprit")


def labels(t: Tables) -> DataFrame:
    touches, _, s, verdicts = verdict_tables(t)
    return cut_lineage(J.labelled(verdicts, touches, s))


SHOW = f"CASE WHEN starts_with(x, '{ROOT}/') THEN substr(x, {len(ROOT) + 2}) WHEN starts_with(x, '{HOME}/') THEN '~/' || substr(x, {len(HOME) + 2}) WHEN x = '{ROOT}' THEN '' ELSE x END"
LABELS = VERDICTS + rf""",
  lab AS (SELECT *, CASE WHEN is_file THEN {SHOW.replace('x', 'culprit')} ELSE tool || ': ' || CASE WHEN length(l) > 50 THEN left(l, 50) || '…' ELSE l END END AS what,
    CASE WHEN culprit IS NOT NULL THEN {SHOW.replace('x', 'culprit')} WHEN starts_with(tool, 'mcp__') THEN 'connected tool' ELSE 'command' END AS thing
    FROM (SELECT *, replace(regexp_replace(regexp_replace(cmd, '^\s*cd\s+\S+\s*(?:&&|;)\s*', ''), '^\s+|\s+$', '', 'g'), chr(10), ' ') AS l FROM verdicts)),
  held AS (SELECT s, cid, arg_min(why, event_id) AS why, arg_min(what, event_id) AS what, min(event_id) AS first_at FROM lab GROUP BY 1, 2),
  brief AS (SELECT s, cid, arg_min(thing, o) AS thing, arg_min(why, o) AS why FROM (SELECT *, CASE WHEN thing = 'command' THEN 10000000000 - event_id ELSE event_id END AS o FROM lab) GROUP BY 1, 2),
  skipped AS (SELECT s, what, arg_max(why, first_at) AS why FROM held GROUP BY 1, 2),
  br AS (SELECT s, cid, thing, {{brief}} AS b FROM brief),
  calls AS (SELECT s, b AS why, thing, count(*) AS n FROM br GROUP BY ALL),
  more AS (SELECT DISTINCT s, {{brief}} AS why, what AS thing FROM skipped WHERE NOT contains(what, ': ') AND NOT starts_with(what, 'attachment')),
  left_out AS (SELECT * FROM calls UNION ALL SELECT m.s, m.why, m.thing, 1 FROM more m ANTI JOIN calls c ON c.s = m.s AND c.why = m.why AND c.thing = m.thing)""".replace(
    "{brief}",
    "CASE WHEN contains(why, 'personal folder') THEN 'personal' WHEN contains(why, 'sensitive') THEN 'secrets' WHEN contains(why, 'unchecked') THEN 'can''t check' "
    "WHEN contains(why, 'connected tool') THEN 'connected tool' ELSE why END",
).replace("{{", "{").replace("}}", "}").replace("{CASE", "CASE").replace("ELSE why END}", "ELSE why END")


@query(f"{LABELS} SELECT s AS session_id, cid AS id, why AS reason, what FROM held")
def withheld_calls(t: Tables) -> DataFrame:
    return J.withheld(labels(t)).select("session_id", "id", "reason", "what")


@query(f"{LABELS} SELECT s AS session_id, why, thing, CAST(n AS BIGINT) AS n FROM left_out")
def left_out(t: Tables) -> DataFrame:
    l = labels(t)
    return R.left_out(J.brief_labels(l), J.skipped_things(l)).drop("project_id")


# --- the sender's whole job --------------------------------------------------------------------------


def planned(t: Tables) -> Plan:
    """A whole run over the lifted logs: every file of an even event exists and holds nothing secret."""
    path = normalize(F.expr(FILE))
    paths = cut_lineage(t.events.where("event_id % 2 = 0").select(path.alias("path")).distinct())
    files = paths.select(
        F.lit("p").alias("project_id"), "path", F.col("path").alias("real_path"), F.lit(True).alias("is_file"),
        F.lit(100).cast("bigint").alias("size"), F.lit(b"x" * 100).alias("content"),
    )
    return plan(Corpus(lines_a(t), sessions(t).withColumn("no_skills", F.lit(False)), files))


@query(f"{LABELS} SELECT s AS session_id, cid AS id, why AS reason FROM held")
def plan_withheld(t: Tables) -> DataFrame:
    return planned(t).withhold.select("session_id", "id", "reason")


@query(f"{LABELS} SELECT s AS session_id, why, thing, CAST(n AS BIGINT) AS n FROM left_out")
def plan_left_out(t: Tables) -> DataFrame:
    return planned(t).left_out.select("session_id", "why", "thing", "n")


@query(
    f"{LABELS} SELECT s AS session_id, why, CAST(sum(n) AS BIGINT) AS total FROM left_out GROUP BY 1, 2 "
    "UNION ALL SELECT s, NULL, CAST(sum(n) AS BIGINT) FROM left_out GROUP BY 1"
)
def left_out_rollup(t: Tables) -> DataFrame:
    l = labels(t)
    return R.left_out_totals(R.left_out(J.brief_labels(l), J.skipped_things(l))).drop("project_id")


@query(
    f"""{LABELS}, g AS (SELECT s, why, count(*) AS n, list(what ORDER BY what) AS whats FROM skipped GROUP BY 1, 2)
    SELECT s AS session_id, why AS reason, CAST(n AS BIGINT) AS n, array_to_string(list_transform(whats[1:3], lambda w: CASE WHEN length(w) > 48 THEN left(w, 48) || '…' ELSE w END), ', ')
    || CASE WHEN n > 3 THEN ', +' || (n - 3) ELSE '' END AS listed FROM g"""
)
def things_by_reason(t: Tables) -> DataFrame:
    return R.things_by_reason(J.skipped_things(labels(t))).drop("project_id")


@query(
    f"{VERDICTS}, hot AS (SELECT s, event_id FROM verdicts WHERE contains(why, 'sensitive')), "
    "said AS (SELECT r.s, r.shown AS text FROM res r JOIN hot ON hot.s = r.s AND hot.event_id = r.call UNION ALL "
    "SELECT e.s, e.cmd FROM ev e JOIN hot ON hot.s = e.s AND hot.event_id = e.event_id WHERE e.k = 'click') "
    f"SELECT DISTINCT s AS session_id, value FROM (SELECT s, unnest({X.learned('text')}) AS value FROM said)"
)
def learned_from_withheld(t: Tables) -> DataFrame:
    touches, texts, _, verdicts = verdict_tables(t)
    return J.learned_values(verdicts, touches, texts).select("session_id", "value")


# --- cleaning ----------------------------------------------------------------------------------------


def lifted_withhold(t: Tables) -> DataFrame:
    ids = F.array(F.lit("c1"), F.lit("c5"))
    return sessions(t).select(*KEYS, F.explode(ids).alias("id"), F.lit("why").alias("reason"))


def cleaned_a(t: Tables):
    s = sessions(t)
    echoes = t.events.where("event_id % 3 = 0").select(
        F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("session_id"), F.lit("id_rsa").alias("value")
    ).distinct()
    return K.clean(lines_a(t), lifted_withhold(t), s, S.scrub_context(s, None, echoes))


NOTE = f"'[withheld by {V.TOOL} when sharing; the agent saw the real content at the time: why]'"
KEPT = f"""WITH {SQL_EV}, a AS (SELECT *, 'c' || CAST(running % 13 AS VARCHAR) AS answers,
    max(CASE WHEN k <> 'error' THEN event_id END) OVER (PARTITION BY s ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept_before FROM ev),
  echoed AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS s FROM events WHERE event_id % 3 = 0)"""


@query(
    f"""{KEPT} SELECT a.s AS session_id, event_id AS line_no, 'e' || CAST(kept_before AS VARCHAR) AS parent,
    CASE WHEN k = 'purchase' THEN CASE WHEN answers IN ('c1', 'c5') THEN {NOTE}
      ELSE CASE event_id % 6 WHEN 0 THEN CASE WHEN e.s IS NULL THEN shown ELSE replace(shown, 'id_rsa', '[REDACTED:repeated]') END
        WHEN 2 THEN 'see' || chr(10) || 'DB_PASSWORD=[REDACTED:config-secret]' ELSE shown END END
      WHEN k = 'signup' THEN 'please ' || event_id
      WHEN cid IN ('c1', 'c5') THEN {NOTE}
      WHEN k = 'view' THEN replace(file, '/work/app', '{V.ROOT}')
      WHEN k = 'click' THEN CASE WHEN e.s IS NULL THEN cmd ELSE replace(cmd, 'id_rsa', '[REDACTED:repeated]') END END AS text
    FROM a LEFT JOIN echoed e ON e.s = a.s WHERE k <> 'error'"""
)
def cleaned_log(t: Tables) -> DataFrame:
    lines, _ = cleaned_a(t)
    lines, v = lines.withColumn("v", F.try_parse_json("raw")), F.col("v")
    block = "$.message.content[0]"
    texts = [text_at(v, p) for p in ("$.message.content", f"{block}.content", f"{block}.input.file_path", f"{block}.input.command")]
    return lines.select("session_id", "line_no", text_at(v, "$.parentUuid").alias("parent"), F.coalesce(*texts).alias("text"))


@query(
    f"""{KEPT} SELECT a.s AS session_id, CAST(sum(CASE WHEN k = 'purchase' AND (answers NOT IN ('c1', 'c5') OR answers IS NULL) THEN
      CASE WHEN event_id % 6 = 2 THEN 1 WHEN event_id % 6 = 0 AND e.s IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS secrets,
    CAST(count(*) FILTER (k = 'purchase' AND answers IN ('c1', 'c5')) AS BIGINT) AS withheld FROM a LEFT JOIN echoed e ON e.s = a.s WHERE k <> 'error' GROUP BY 1"""
)
def clean_counters(t: Tables) -> DataFrame:
    _, counters = cleaned_a(t)
    return counters.select("session_id", "secrets", "withheld")


# --- agent B -------------------------------------------------------------------------------------------

SQL_B = """WITH ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS s, event_type AS k FROM events),
  st AS (SELECT *, max(CASE WHEN k = 'click' THEN event_id END) OVER w AS called, max(CASE WHEN k = 'purchase' THEN event_id END) OVER w AS closed,
    last_value(CASE WHEN k = 'signup' THEN '/work/app/d ' || (event_id % 3) END IGNORE NULLS) OVER w AS folder
    FROM ev WINDOW w AS (PARTITION BY s ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  ow AS (SELECT *, CASE WHEN k = 'click' THEN 'c' || event_id WHEN k = 'purchase' THEN coalesce('c' || called, 'nobody')
    WHEN k = 'view' AND called IS NOT NULL AND (closed IS NULL OR closed < called) THEN 'c' || called END AS owner FROM st)"""


@query(f"{SQL_B} SELECT s AS session_id, event_id AS line_no, owner, coalesce(folder, '/') AS cwd FROM ow WHERE k IN ('click', 'view', 'purchase')")
def call_in_progress(t: Tables) -> DataFrame:
    marks = U.marks_b(lines_b(t))
    return marks.where(F.col("kind").isNotNull()).select("session_id", "line_no", "owner", "cwd")


@query(
    f"""{SQL_B} SELECT s AS session_id, event_id AS line_no, owner AS id, CASE WHEN k = 'click' THEN 'exec' ELSE 'Bash' END AS tool, coalesce(folder, '/') AS cwd,
    CASE WHEN k = 'click' THEN 'await tools.' || CASE WHEN event_id % 3 = 0 THEN 'web_run' ELSE 'exec_command' END || '({{}})' ELSE 'cat f' || event_id END AS command,
    k = 'click' AND event_id % 3 = 0 AS opaque FROM ow WHERE k = 'click' OR (k = 'view' AND owner IS NOT NULL AND event_id % 5 <> 0)""".replace("{{}}", "{}")
)
def script_calls(t: Tables) -> DataFrame:
    touches, _ = U.touches_b(lines_b(t))
    return touches.select("session_id", F.shiftright("touch_no", 31).alias("line_no"), "id", "tool", "cwd", "command", "opaque")


@query(
    f"""{SQL_B}, d AS (SELECT s, owner, min(event_id) AS first_at FROM ow WHERE k = 'view' AND event_id % 5 <> 0 GROUP BY 1, 2)
    SELECT ow.s AS session_id, event_id AS line_no, 'shell' AS tool, coalesce(owner, '') AS id, 'out ' || event_id AS content FROM ow WHERE k = 'view' AND event_id % 5 <> 0
    UNION ALL SELECT ow.s, event_id, 'other', ow.owner, 'done ' || event_id FROM ow LEFT JOIN d ON d.s = ow.s AND d.owner = ow.owner
    WHERE k = 'purchase' AND (d.first_at IS NULL OR d.first_at > event_id)"""
)
def described_calls(t: Tables) -> DataFrame:
    n = N.to_neutral(lines_b(t))
    line = F.shiftright("seq", 31).alias("line_no")
    call = n.where(F.col("type") == "tool_call").select("session_id", line, "tool", "id")
    said = n.where(F.col("type") == "tool_result").select("session_id", line, "content")
    return call.join(said, ["session_id", "line_no"])


@query(
    f"""{SQL_B} SELECT s AS session_id, event_id AS line_no, CASE WHEN k = 'view' AND (event_id % 5 = 0 OR owner IS NULL) THEN {q(V.UNTRACED)}
    WHEN k = 'purchase' AND owner = 'nobody' THEN {q(V.UNTRACED)} WHEN owner LIKE '%7' THEN 'why' END AS reason FROM ow WHERE k <> 'error'"""
)
def untraced_records(t: Tables) -> DataFrame:
    s = sessions(t, V.AGENT_B)
    withhold = t.events.where((F.col("event_type") == "click") & (F.col("event_id") % 10 == 7)).select(
        F.lit("p").alias("project_id"), F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("c"), F.col("event_id")).alias("id"), F.lit("why").alias("reason"),
    )
    return K.decide_b(lines_b(t), withhold, s).where("kept").select("session_id", "line_no", "reason")


# --- order, latest, wording --------------------------------------------------------------------------------


@query(
    "SELECT user_id, event_id FROM (SELECT *, max(CASE WHEN event_id % 97 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS cut FROM events) WHERE cut IS NULL OR event_id >= cut"
)
def compaction_cut(t: Tables) -> DataFrame:
    return O.since_last(t.events.select("user_id", "event_id"), ["user_id"], "event_id", F.col("event_id") % 97 == 0)


@query(
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1"
)
def latest_event_per_user(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", F.lit("p").alias("project_id"), F.col("event_id").alias("session_id"), F.col("ts").alias("modified"))
    return C.latest(e, ["user_id"]).select("user_id", F.col("session_id").alias("event_id"), "event_type")


@query(
    """SELECT user_id, CAST(n AS BIGINT) AS event_no, event_id, CAST(sum(event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)"""
)
def numbered_records(t: Tables) -> DataFrame:
    rows = O.number_rows(t.events.select("user_id", "event_id"), ["user_id"], "event_id", "event_no", chunk=1000)
    total = O.running_total(rows, ["user_id"], "event_id", F.col("event_id") % 5, "before", chunk=777)
    return total.withColumn("before", F.when(F.col("event_no") > 0, F.col("before")))


@query(
    """SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 10000 THEN (n // 1000) || 'k' WHEN n >= 1000 THEN printf('%.1fk', n / 1e3) ELSE CAST(n AS VARCHAR) END AS tokens,
    CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN (n // 1024) || ' KB' ELSE n || ' B' END AS size,
    CASE WHEN n = 1 THEN '1 file' ELSE n || ' files' END AS files, CASE WHEN n > 1000000 THEN 'too large to load' WHEN n > 150000 THEN 'large' END AS warning
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 1 ELSE 12.7 END) AS BIGINT) AS n FROM orders)"""
)
def short_counts(t: Tables) -> DataFrame:
    n = F.col("n")
    return t.orders.select(
        "o_orderkey",
        F.floor(F.col("o_totalprice") * F.expr("CASE o_orderkey % 4 WHEN 0 THEN 0.01D WHEN 1 THEN 1D ELSE 12.7D END")).cast("bigint").alias("n"),
    ).select(
        "o_orderkey", T.short_count(n).alias("tokens"), T.size_words(n).alias("size"), T.counted(n, "file").alias("files"),
        N.size_warning(n).alias("warning"),
    )


@query(
    rf"""SELECT doc_id, CASE WHEN length(w) > 60 THEN left(w, 60) || '…' ELSE w END AS line, CASE WHEN length(text) > 2000 THEN left(text, 2000) || chr(10) || '… (trimmed)' ELSE text END AS trimmed,
    CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '^\s+', '') ELSE text END AS bare, text = '' OR regexp_matches(text, '^\s*$') AS blank
    FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS w FROM documents)"""
)
def wording(t: Tables) -> DataFrame:
    text = F.col("text")
    moved = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(f"{V.INTRO_START}X. {V.INTRO_END}\n\n"), text)).otherwise(text)
    return t.documents.select(
        "doc_id", T.short_line(text, 60).alias("line"), T.trim_long(text, V.RESULT_LIMIT).alias("trimmed"),
        T.strip_intro(moved).alias("bare"), T.is_blank(text).alias("blank"),
    )
