"""The neutral conversation and token estimates (K7, K8; H29-H31, J18, W1, A5, A6, U3).

``neutral``: keys, agent, seq (order), role, type, text, id, tool, name, input (JSON text), content, is_error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.jsontext import field, items_at, members_at, strings, structure, text_at, true_at
from ..functions.let import empty_strings, first_of
from .ordered import since_last
from .touches import KEYS, marks_b, place, with_owner

ROW = [*KEYS, "agent", "seq", "role", "type", "text", "id", "tool", "name", "input", "content", "is_error"]


def with_v(clean_lines: DataFrame) -> DataFrame:
    return clean_lines.withColumn("v", F.try_parse_json("raw"))


_ENTRY = (
    "struct<sub:int,role:string,type:string,text:string,id:string,tool:string,name:string,input:string,"
    "content:string,is_error:boolean>"
)


def _entry(sub: Column, type_: str, **cols: Column) -> Column:
    """One neutral row as a struct; a line yields an array of them."""
    null = F.lit(None).cast("string")
    at = lambda name: cols.get(name, null)
    return F.struct(
        sub.alias("sub"),
        at("role").alias("role"),
        F.lit(type_).alias("type"),
        *[at(c).alias(c) for c in ("text", "id", "tool", "name", "input", "content")],
        cols.get("is_error", F.lit(None).cast("boolean")).alias("is_error"),
    ).cast(_ENTRY)


def _exploded(lines: DataFrame, entries: Column) -> DataFrame:
    rows = lines.select(*KEYS, "agent", "line_no", F.explode(entries).alias("e"))
    return rows.select(*KEYS, "agent", place(F.col("line_no"), F.col("e.sub")).alias("seq"), *[F.col(f"e.{c}") for c in ROW[4:]])


def result_text(content: Column) -> Column:
    """A result's text: a string, or its parts joined by new lines with ``[type]`` for what is not text."""
    part = lambda p: F.coalesce(
        text_at(p, "$.text"), F.concat(F.lit("["), F.coalesce(text_at(p, "$.type"), F.lit("content")), F.lit("]"))
    )
    return F.coalesce(
        text_at(content, "$"), F.array_join(F.transform(items_at(content, "$"), part), "\n"), F.lit("")
    )


def tool_kind(name: Column) -> Column:
    """What kind of tool a name is."""
    return first_of(
        *[(name == tool, F.lit(kind)) for tool, kind in V.A_TOOL_KINDS.items()],
        (F.startswith(name, F.lit("mcp__")), F.lit("connected_tool")),
    ).otherwise("other")


def neutral_a(lines: DataFrame) -> DataFrame:
    """Agent A's cleaned lines as neutral rows, from the last compaction on, side chains and meta lines out."""
    v = F.col("v")
    a = since_last(
        lines.where(F.col("agent") == V.AGENT_A), KEYS, "line_no", true_at(v, "$.isCompactSummary")
    ).where(~true_at(v, "$.isSidechain"))
    ltype, zero = F.col("ltype"), F.lit(0)
    text, content = text_at(v, "$.message.content"), field(v, "$.message.content")
    said = ltype.isin("user", "assistant") & ~true_at(v, "$.isMeta")

    def part(b: Column, i: Column) -> Column:
        kind, name = text_at(b, "$.type"), F.coalesce(text_at(b, "$.name"), F.lit(""))
        return first_of(
            (kind == "text", _entry(i, "text", role=ltype, text=text_at(b, "$.text"))),
            (
                kind == "tool_use",
                _entry(
                    i, "tool_call", role=F.lit("assistant"), id=text_at(b, "$.id"), tool=tool_kind(name), name=name,
                    input=F.to_json(field(b, "$.input")),
                ),
            ),
            (
                kind == "tool_result",
                _entry(
                    i, "tool_result", role=F.lit("tool"), id=text_at(b, "$.tool_use_id"),
                    content=result_text(field(b, "$.content")), is_error=true_at(b, "$.is_error"),
                ),
            ),
        )

    entries = first_of(
        (ltype == "summary", F.array(_entry(zero, "summary", text=text_at(v, "$.summary")))),
        (said & true_at(v, "$.isCompactSummary"), F.array(_entry(zero, "summary", text=result_text(content)))),
        (said & text.isNotNull(), F.array(_entry(zero, "text", role=ltype, text=text))),
        (
            said,
            F.filter(F.transform(items_at(v, "$.message.content"), part), lambda e: e.isNotNull()),
        ),
    )
    return _exploded(a.withColumn("ltype", text_at(v, "$.type")), entries)


def visible_text(json: Column) -> Column:
    """All strings of a record but part-type names, joined by new lines."""
    return F.array_join(F.filter(strings(json), lambda s: ~F.rlike(s, F.lit("^(?:input|output)_"))), "\n")


def neutral_b(lines: DataFrame) -> DataFrame:
    """Agent B's cleaned lines as neutral rows: messages, and the commands and changes it logged; a call
    without any is described by its output (J18)."""
    v = F.col("v")
    b = lines.where(F.col("agent") == V.AGENT_B)
    marks = since_last(marks_b(b), KEYS, "line_no", (F.col("type") == "compacted").eqNullSafe(F.lit(True)))
    called = F.coalesce("owner", F.lit(""))
    # An output is described by events that came before it: the earliest event per call decides.
    first_event = (
        marks.where((F.col("kind") == "item") & F.col("itype").isin("CommandExecution", "FileChange"))
        .groupBy(*KEYS, called.alias("call"))
        .agg(F.min("line_no").alias("described"))
    )
    # Lines that are no output join on a key of their own, so no null key gathers them in one task.
    marks = marks.withColumn(
        "call", F.when(F.col("kind") == "output", called).otherwise(F.concat(F.lit("\u0000"), F.col("line_no")))
    ).join(first_event, [*KEYS, "call"], "left")
    b = with_owner(b, marks.drop("cwd"))
    zero, one = F.lit(0), F.lit(1)
    message, role = text_at(v, "$.payload.message"), text_at(v, "$.payload.role")
    parts = F.filter(
        F.transform(items_at(v, "$.payload.content"), lambda c: text_at(c, "$.text")),
        lambda t: t.isNotNull() & ~F.startswith(t, F.lit("<environment_context>")),
    )
    itype = F.col("itype")
    alone = F.col("described").isNull() | (F.col("described") > F.col("line_no"))

    def pair(tool: Column, name: Column, input_: Column, result: Column) -> Column:
        return F.array(
            _entry(zero, "tool_call", role=F.lit("assistant"), id=called, tool=tool, name=name, input=input_),
            _entry(one, "tool_result", role=F.lit("tool"), id=called, content=result, is_error=F.lit(False)),
        )

    words = items_at(v, "$.payload.item.command")
    command = F.coalesce(F.to_json(F.element_at(F.concat(F.array(F.parse_json(F.lit("null"))), words), -1)), F.lit("null"))
    files = F.to_json(F.coalesce(F.map_keys(members_at(v, "$.payload.item.changes")), empty_strings()))
    shell, edit = F.lit("shell"), F.lit("edit_file")
    entries = first_of(
        ((F.col("type") == "compacted") & (F.length(message) > 0), F.array(_entry(zero, "summary", text=message))),
        (
            (F.col("type") == "response_item") & (F.col("ptype") == "message") & role.isin("user", "assistant"),
            F.filter(F.array(_entry(zero, "text", role=role, text=F.array_join(parts, "\n"))), lambda _: F.size(parts) > 0),
        ),
        (
            (F.col("kind") == "item") & (itype == "CommandExecution"),
            pair(
                shell, shell, F.concat(F.lit('{"command":'), command, F.lit("}")),
                visible_text(F.to_json(field(v, "$.payload.item.aggregated_output"))),
            ),
        ),
        (
            (F.col("kind") == "item") & (itype == "FileChange"),
            pair(edit, edit, F.concat(F.lit('{"files":'), files, F.lit("}")), F.lit("")),
        ),
        (
            (F.col("kind") == "output") & alone,
            pair(F.lit("other"), F.lit("exec"), F.lit("{}"), visible_text(F.to_json(field(v, "$.payload.output")))),
        ),
    )
    return _exploded(b, entries)


def to_neutral(clean_lines: DataFrame) -> DataFrame:
    """Both agents' cleaned lines (keys, agent, line_no, raw) as one neutral table."""
    lines = clean_lines if "v" in clean_lines.columns else with_v(clean_lines)
    return neutral_a(lines).unionByName(neutral_b(lines)).select(*ROW)


def neutral_json(neutral: DataFrame) -> DataFrame:
    """``keys, seq, json``: each neutral row as the JSON object the format describes."""
    pick = lambda *cols: F.to_json(F.struct(*cols))
    call = F.map_concat(
        members_at(F.try_parse_json(pick("role", "type", "id", "tool", "name")), "$"),
        F.create_map(F.lit("input"), F.coalesce(F.try_parse_json("input"), F.parse_json(F.lit("null")))),
    )
    json = first_of(
        (F.col("type") == "summary", pick("type", "text")),
        (F.col("type") == "tool_call", F.to_json(call)),
        (F.col("type") == "tool_result", pick("role", "type", "id", "content", "is_error")),
    ).otherwise(pick("role", "type", "text"))
    return neutral.select(*KEYS, "seq", json.alias("json"))


# --- token estimates ------------------------------------------------------------------------


def text_tokens(n_bytes: Column, agent: Column) -> Column:
    """Tokens an agent's models spend on so many bytes of session text."""
    return first_of(
        *[(agent == a, F.floor(n_bytes * 10 / F.lit(d)).cast("bigint")) for a, d in V.TOKEN_DIVISOR.items()]
    )


def image_tokens(n: Column, agent: Column) -> Column:
    return first_of(*[(agent == a, n * t) for a, t in V.IMAGE_TOKENS.items()])


def estimate_tokens(clean_lines: DataFrame) -> DataFrame:
    """``agent, bytes, images, tokens`` per session: what the agent reads when it resumes."""
    lines = clean_lines if "v" in clean_lines.columns else with_v(clean_lines)
    v, is_a = F.col("v"), F.col("agent") == V.AGENT_A
    ltype = text_at(v, "$.type")
    marker = F.when(is_a, true_at(v, "$.isCompactSummary")).otherwise((ltype == "compacted").eqNullSafe(F.lit(True)))
    read = first_of(
        (is_a & ltype.isin("user", "assistant"), F.to_json(field(v, "$.message.content"))),
        (is_a & (ltype == "attachment"), F.to_json(field(v, "$.attachment"))),
        (~is_a & ltype.isin("response_item", "compacted"), F.to_json(field(v, "$.payload"))),
    )
    seen = since_last(lines, KEYS, "line_no", marker)
    sums = (
        seen.select(*KEYS, "agent", read.alias("json"))
        .select(*KEYS, "agent", F.when(F.col("json").isNotNull(), structure(F.col("json"))).alias("s"))
        .groupBy(*KEYS, "agent")
        .agg(
            F.coalesce(F.sum("s.bytes"), F.lit(0)).cast("bigint").alias("bytes"),
            F.coalesce(F.sum("s.images"), F.lit(0)).cast("bigint").alias("images"),
        )
    )
    agent = F.col("agent")
    return sums.withColumn(
        "tokens", (text_tokens(F.col("bytes"), agent) + image_tokens(F.col("images"), agent)).cast("bigint")
    )


def size_warning(tokens: Column) -> Column:
    """What to warn about a session's size."""
    return first_of((tokens > V.HUGE_TOKENS, F.lit("too large to load")), (tokens > V.LARGE_TOKENS, F.lit("large")))
