"""Plain turns another agent can resume, and logs built from them (K9, K10; H13-H15, W4, W8-W10, A7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.jsontext import items_at, text_at
from ..functions.let import first_of, let
from ..functions.text import is_blank, stable_uuid, strip_intro, trim_long, trimmed
from ..session import cut_lineage
from .ordered import SEQ_CHUNK, carry_forward, islands, joined_texts, number_rows, running_total
from .neutral import text_tokens
from .touches import KEYS



def describe_call(tool: Column, name: Column, input_json: Column) -> Column:
    """A tool call in one line, like ``▸ ran `npm test```."""

    def line(v: Column) -> Column:
        first = lambda *keys: F.coalesce(
            trim_long(F.coalesce(*[text_at(v, f"$.{k}") for k in keys]), V.ARGUMENT_LIMIT), F.lit("")
        )
        ticked = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
        listed = F.transform(
            F.filter(F.transform(items_at(v, "$.files"), lambda f: text_at(f, "$")), lambda f: f.isNotNull()), ticked
        )
        files = F.coalesce(F.array_join(listed, ", "), ticked(first("file_path", "path", "notebook_path")))
        say = lambda head, x: F.concat(F.lit(f"▸ {head} "), x)
        return first_of(
            (tool == "shell", say("ran", ticked(first("command", "cmd")))),
            (tool == "read_file", say("read", files)),
            (tool == "write_file", say("wrote", files)),
            (tool == "edit_file", say("edited", files)),
            (tool == "search", say("searched for", ticked(first("pattern", "query")))),
            (tool == "list_files", say("listed", ticked(first("pattern", "path")))),
            (tool == "subagent", say("asked a helper agent:", first("description", "prompt"))),
            (tool == "web", say("looked up", first("url", "query"))),
        ).otherwise(say("used", F.coalesce(name, F.lit("a tool"))))

    return let(F.coalesce(F.try_parse_json(input_json), F.parse_json(F.lit("{}"))), line)


def spoken(neutral: DataFrame) -> DataFrame:
    """``seq, user, text``: each neutral row as something one side says, empty ones out."""
    text, result = F.coalesce("text", F.lit("")), trimmed(F.coalesce("content", F.lit("")))
    is_user = (F.col("role") == "user").eqNullSafe(F.lit(True))
    rows = neutral.select(
        *KEYS,
        "seq",
        (((F.col("type") == "text") & is_user) | (F.col("type") == "summary")).alias("user"),
        first_of(
            ((F.col("type") == "text") & is_user, strip_intro(text)),
            (F.col("type") == "text", text),
            (F.col("type") == "tool_call", describe_call(F.col("tool"), F.col("name"), F.col("input"))),
            (
                F.col("type") == "tool_result",
                F.when(result != "", F.concat(F.lit("```\n"), trim_long(result, V.RESULT_LIMIT), F.lit("\n```"))),
            ),
            (F.col("type") == "summary", F.concat(F.lit(V.SUMMARY_HEAD + "\n"), text)),
        ).alias("text"),
    )
    return rows.where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def intro(label: Column) -> Column:
    return F.concat(
        F.lit(V.INTRO_START), label, F.lit(f" and was moved here with {V.TOOL}. "), label,
        F.lit("'s tool calls appear as text lines (▸ …) " + V.INTRO_END),
    )


def to_turns(neutral: DataFrame, sessions: DataFrame) -> DataFrame:
    """``turn_no, user, text``: alternating turns, the user's first with one intro, the agent's last (K9).

    ``sessions`` (keys, agent) names every session, so one without any text still gets its two turns.
    """
    rows = spoken(neutral)
    placed = cut_lineage(islands(cut_lineage(rows.select(*KEYS, "seq", "user")), KEYS, "seq", "user", SEQ_CHUNK))
    heads = cut_lineage(
        number_rows(placed.where(F.col("seq") == F.col("island")).select(*KEYS, "island", "user"), KEYS, "island", "n", SEQ_CHUNK)
    )
    label = first_of(*[(F.col("agent") == a, F.lit(name)) for a, name in V.LABELS.items()])
    opens = heads.groupBy(*KEYS).agg(
        F.max("n").alias("_last"), F.min_by("user", "n").alias("_opens"), F.max_by("user", "n").alias("_closes")
    )
    ends = sessions.select(*KEYS, intro(label).alias("_intro")).join(opens, KEYS, "left")
    merged = joined_texts(rows.select(*KEYS, "seq", "text"), placed, KEYS, "seq", "text", "\n\n")
    merged = merged.join(heads, [*KEYS, "island"]).join(ends.where(F.col("_last").isNotNull()), KEYS)
    first, last = F.col("n") == 0, F.col("n") == F.col("_last")
    turn = lambda no, user, text: F.struct(no.cast("bigint").alias("turn_no"), user.alias("user"), text.alias("text"))
    greeting = lambda no: turn(no, F.lit(True), F.col("_intro"))
    parting = lambda no: turn(no, F.lit(False), F.lit(V.PICKED_UP))
    body = F.when(first & F.col("user"), F.concat("_intro", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    no = F.col("n") + F.when(F.col("_opens"), 0).otherwise(1)
    # Each merged turn yields itself, plus the intro before the first or the end after the last.
    every = F.array(
        F.when(first & ~F.col("user"), greeting(F.lit(0))),
        turn(no, F.col("user"), body),
        F.when(last & F.col("user"), parting(no + 1)),
    )
    some = merged.select(*KEYS, F.explode(F.filter(every, lambda t: t.isNotNull())).alias("t"))
    silent = ends.where(F.col("_last").isNull()).select(
        *KEYS, F.explode(F.array(greeting(F.lit(0)), parting(F.lit(1)))).alias("t")
    )
    return some.unionByName(silent).select(*KEYS, "t.turn_no", "t.user", "t.text")


def turn_tokens(turns: DataFrame, target: str) -> DataFrame:
    """Tokens the target agent spends on carried turns."""
    return (
        turns.groupBy(*KEYS)
        .agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))
        .withColumn("tokens", text_tokens(F.col("bytes"), F.lit(target)))
    )


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def log_a(turns: DataFrame, folder: str, now: str) -> DataFrame:
    """Agent A's log holding ``turns``: each entry points at the one before (W9). Ids derive from the
    session and turn, so a repeated run writes the same log."""
    sid = stable_uuid(F.lit("session-a"), *_keys())
    uuid = lambda n: stable_uuid(F.lit("turn-a"), *_keys(), n)
    n, user = F.col("turn_no"), F.col("user")
    said = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    told = F.struct(
        F.concat(F.lit(f"msg_{V.TOOL}_"), n.cast("string")).alias("id"),
        F.lit("message").alias("type"),
        F.lit("assistant").alias("role"),
        F.lit("<synthetic>").alias("model"),
        F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"),
        F.lit("end_turn").alias("stop_reason"),
        F.lit(None).cast("string").alias("stop_sequence"),
        F.struct(F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens")).alias("usage"),
    )
    entry = lambda kind, message: _json(
        F.lit(kind).alias("type"),
        uuid(n).alias("uuid"),
        F.when(n > 0, uuid(n - 1)).alias("parentUuid"),
        sid.alias("sessionId"),
        F.lit(folder).alias("cwd"),
        F.lit("2.1.0").alias("version"),
        F.lit(now).alias("timestamp"),
        F.lit(False).alias("isSidechain"),
        F.lit("external").alias("userType"),
        message.alias("message"),
    )
    return turns.select(
        *KEYS,
        sid.alias("new_id"),
        F.lit(V.AGENT_A).alias("agent"),
        n.alias("line_no"),
        F.when(user, entry("user", said)).otherwise(entry("assistant", told)).alias("raw"),
    )


def _keys() -> list[Column]:
    return [F.col(k) for k in KEYS]


def tasks(turns: DataFrame) -> DataFrame:
    """Turns with ``task_no``: the turn number of the user turn that opened the current task."""
    return carry_forward(turns, KEYS, "turn_no", {"task_no": F.when(F.col("user"), F.col("turn_no"))})


def log_b(turns: DataFrame, folder: str, now: str, now_seconds: int, note: str) -> DataFrame:
    """Agent B's log holding ``turns``: every record numbered, each exchange wrapped as a task, the
    display events its screen shows, and the note as a developer message (W8, W10)."""
    sid = stable_uuid(F.lit("session-b"), *_keys())
    task_id = lambda n: F.when(n.isNotNull(), stable_uuid(F.lit("task-b"), *_keys(), n)).otherwise("")
    narrow = tasks(cut_lineage(turns.select(*KEYS, "turn_no", "user")))
    before = carry_forward(
        cut_lineage(narrow),
        KEYS,
        "turn_no",
        {"agent_turn": F.when(~F.col("user"), F.col("turn_no")), "open_task": F.col("task_no")},
        before=True,
    )
    ends = narrow.groupBy(*KEYS).agg(F.min("turn_no").alias("_first"), F.max("turn_no").alias("_last"))
    shape = before.join(ends, KEYS)
    one = lambda test: test.cast("int")
    is_first, is_last = F.col("turn_no") == F.col("_first"), F.col("turn_no") == F.col("_last")
    closes = F.col("user") & F.col("open_task").isNotNull()
    n_records = (
        F.lit(2) + one(is_first) + one(closes) + one(F.col("user")) + one(is_last)
        + one(is_last & F.col("task_no").isNotNull())
    )
    shape = cut_lineage(running_total(cut_lineage(shape), KEYS, "turn_no", n_records, "first_ordinal"))
    # The agent's last words are needed where a task closes; other turns join on a key no turn has.
    wanted = F.when(closes | (is_last & F.col("user")), F.col("agent_turn"))
    shape = shape.withColumn("_agent_turn", F.coalesce(wanted, -1 - F.col("turn_no")))
    words = turns.select(*KEYS, F.col("turn_no").alias("_agent_turn"), F.col("text").alias("last_agent"))
    rows = (
        turns.select(*KEYS, "turn_no", "text")
        .join(shape, [*KEYS, "turn_no"])
        .join(words, [*KEYS, "_agent_turn"], "left")
    )
    n, user, text = F.col("turn_no"), F.col("user"), F.col("text")
    payload = lambda kind, *fields: F.struct(F.lit(kind).alias("type"), *fields)
    secs = F.lit(now_seconds).cast("bigint")

    def completed(task: Column, last: Column) -> Column:
        return payload(
            "task_complete", task.alias("turn_id"), F.coalesce(last, F.lit("")).alias("last_agent_message"),
            secs.alias("started_at"), secs.alias("completed_at"), F.lit(0).alias("duration_ms"),
            F.lit(0).alias("time_to_first_token_ms"),
        )

    meta = F.struct(
        sid.alias("id"), sid.alias("session_id"), F.lit(now).alias("timestamp"), F.lit(folder).alias("cwd"),
        F.array(F.lit(folder)).alias("runtime_workspace_roots"), F.lit("codex_exec").alias("originator"),
        F.lit("0.0.0").alias("cli_version"), F.lit("exec").alias("source"), F.lit("user").alias("thread_source"),
        F.lit("paginated").alias("history_mode"), F.lit("openai").alias("model_provider"),
    )
    started = payload(
        "task_started", task_id(n).alias("turn_id"), task_id(n).alias("root_turn_id"), secs.alias("started_at"),
        F.lit(258_400).alias("model_context_window"), F.lit("default").alias("collaboration_mode_kind"),
    )
    here = task_id(F.col("task_no"))
    through = F.struct(here.alias("turn_id")).alias("internal_chat_message_metadata_passthrough")
    part = lambda kind, t: F.array(F.struct(F.lit(kind).alias("type"), t.alias("text"))).alias("content")
    said = payload("message", F.lit("user").alias("role"), part("input_text", text), through)
    told = payload("message", F.lit("assistant").alias("role"), part("output_text", text), through)
    item_id = stable_uuid(F.lit("item-b"), *_keys(), n).alias("id")
    nothing = F.array().cast("array<string>").alias("text_elements")
    shown_user = F.struct(
        F.lit("UserMessage").alias("type"), item_id,
        F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), nothing)).alias("content"),
    )
    shown_agent = F.struct(
        F.lit("AgentMessage").alias("type"), item_id, part("Text", text), F.lit("final_answer").alias("phase")
    )
    item = lambda shown: payload(
        "item_completed", sid.alias("thread_id"), here.alias("turn_id"), shown.alias("item"),
        (secs * 1000).alias("started_at_ms"), (secs * 1000).alias("completed_at_ms"),
    )
    developer = payload("message", F.lit("developer").alias("role"), part("input_text", F.lit(note)))
    last_said = F.when(~user, text).otherwise(F.col("last_agent"))
    # Each turn yields its records as an array; their place in the log is the turn, then the place in the array.
    record = lambda when, kind, body: F.when(when, F.struct(F.lit(kind).alias("kind"), F.to_json(body).alias("payload")))
    records = F.array(
        record(is_first, "session_meta", meta),
        record(user & F.col("open_task").isNotNull(), "event_msg", completed(task_id(F.col("open_task")), F.col("last_agent"))),
        record(user, "event_msg", started),
        record(user, "response_item", said),
        record(~user, "response_item", told),
        record(user, "event_msg", item(shown_user)),
        record(~user, "event_msg", item(shown_agent)),
        record(is_last, "response_item", developer),
        record(is_last & F.col("task_no").isNotNull(), "event_msg", completed(here, last_said)),
    )
    numbered = rows.select(
        *KEYS,
        sid.alias("new_id"),
        "first_ordinal",
        F.posexplode(F.filter(records, lambda r: r.isNotNull())).alias("_sub", "r"),
    ).select(*KEYS, "new_id", (F.col("first_ordinal") + F.col("_sub")).alias("line_no"), "r.kind", "r.payload")
    raw = F.concat(
        F.lit('{"ordinal":'), F.col("line_no").cast("string"), F.lit(f',"payload":'), F.col("payload"),
        F.lit(f',"timestamp":"{now}","type":"'), F.col("kind"), F.lit('"}'),
    )
    return numbered.select(*KEYS, "new_id", F.lit(V.AGENT_B).alias("agent"), "line_no", raw.alias("raw"))
