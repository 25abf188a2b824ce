"""What every tool call and attachment touched (K1, K2; J1-J4, H26-H28, H32, H33, W2, W3).

Two tables instead of one nested record, so that no call's output is ever collected:

``touches``  project_id, session_id, touch_no, id, tool, attachment, cwd, file, opaque, command
``texts``    project_id, session_id, touch_no, kind ('input' | 'output'), ord, sub, text

``touch_no`` orders the touches of a session; ``command`` is the first input text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.commands import patched_files, unknown_script_tool, without_patches
from ..functions.jsontext import EVENT, decode, field, is_key, items_at, members_at, strings, text_at
from ..functions.let import empty_strings, first_of, let
from ..functions.paths import join, path_of_url
from ..session import cut_lineage
from .ordered import carry_forward

KEYS = ["project_id", "session_id"]
TOUCH = [*KEYS, "touch_no", "id", "tool", "attachment", "cwd", "file", "opaque", "command"]
TEXT = [*KEYS, "touch_no", "kind", "ord", "sub", "text"]


def place(line_no: Column, sub: Column) -> Column:
    """One sortable number for a position within a line."""
    return F.shiftleft(line_no.cast("bigint"), 31) + sub


def blocks(lines: DataFrame, *extra: str | Column) -> DataFrame:
    """One row per content block of agent A's lines: ``line_no, pos, b`` and ``extra`` columns."""
    return lines.select(*KEYS, "line_no", *extra, F.posexplode(items_at(F.col("v"), "$.message.content")).alias("pos", "b"))


def attachment_file(json: Column) -> Column:
    """The file an attachment names, wherever in it: an object's own keys first, then its members in order."""
    events = F.regexp_extract_all(json, F.lit(EVENT), F.lit(0))
    hit = "array<struct<at:array<int>,text:string>>"
    state_type = f"struct<path:array<int>,key:string,hits:{hit}>"
    rank = lambda k: first_of(*[(k == f'"{name}":', F.lit(i)) for i, name in enumerate(V.A_ATTACHMENT_KEYS)])
    bumped = lambda path: F.concat(
        F.slice(path, F.lit(1), F.size(path) - 1), F.array(F.element_at(path, -1) + 1)
    )

    # ``path`` holds, per open object or array, how many members came before; a hit sorts by the
    # path to its object, then 0 and its key's rank, so own keys come before any child's.
    def step(s: Column, e: Column) -> Column:
        st = lambda path, key, hits: F.struct(
            path.alias("path"), key.cast("string").alias("key"), hits.alias("hits")
        ).cast(state_type)
        own = F.concat(F.slice(s["path"], F.lit(1), F.size(s["path"]) - 1), F.array(F.lit(0), rank(s["key"])))
        found = F.when(
            rank(s["key"]).isNotNull(),
            F.concat(s["hits"], F.array(F.struct(own.alias("at"), e.alias("text")))),
        ).otherwise(s["hits"])
        return first_of(
            (e.isin("{", "["), st(F.concat(bumped(s["path"]), F.array(F.lit(0))), F.lit(None), s["hits"])),
            (e.isin("}", "]"), st(F.slice(s["path"], F.lit(1), F.size(s["path"]) - 1), F.lit(None), s["hits"])),
            (is_key(e), st(s["path"], e, s["hits"])),
        ).otherwise(st(bumped(s["path"]), F.lit(None), found))

    start = F.struct(
        F.array(F.lit(0)).alias("path"), F.lit(None).cast("string").alias("key"), F.array().cast(hit).alias("hits")
    )
    best = F.aggregate(events, start.cast(state_type), step, lambda s: F.array_min(s["hits"])["text"])
    return let(best, lambda token: F.when(token.isNotNull(), F.get(decode(F.array(token)), F.lit(0))))


def calls_a(lines: DataFrame) -> DataFrame:
    """Agent A's tool calls and attachments in one pass over the lines, each with its own texts."""
    a, v, b = lines.where(F.col("agent") == V.AGENT_A), F.col("v"), F.col("b")
    is_attachment = F.coalesce(text_at(v, "$.type") == "attachment", F.lit(False))
    uses = F.filter(
        F.transform(items_at(v, "$.message.content"), lambda x, i: F.struct(i.alias("pos"), x.alias("b"))),
        lambda x: (text_at(x["b"], "$.type") == "tool_use").eqNullSafe(F.lit(True)),
    )
    # An attachment line yields the attachment; any other line its tool calls.
    attachment = F.array(F.struct(F.lit(0).alias("pos"), field(v, "$.attachment").alias("b")))
    rows = a.select(
        *KEYS,
        "line_no",
        F.coalesce(text_at(v, "$.cwd"), F.lit("/")).alias("cwd"),
        is_attachment.alias("attachment"),
        text_at(v, "$.uuid").alias("uuid"),
        F.explode(F.when(is_attachment, attachment).otherwise(uses)).alias("x"),
    ).select(*KEYS, "line_no", "cwd", "attachment", "uuid", "x.pos", "x.b")
    name = text_at(b, "$.name")
    named = first_of(*[(name == tool, text_at(b, f"$.input.{key}")) for tool, key in V.A_FILE_TOOLS.items()])
    rows = rows.withColumn("json", F.when(F.col("attachment"), F.to_json("b")).otherwise(F.to_json(field(b, "$.input"))))
    rows = rows.withColumn(
        "named", F.when(F.col("attachment"), attachment_file(F.coalesce("json", F.lit("")))).otherwise(named)
    ).withColumn("said", strings(F.col("json")))
    is_call, wanted = ~F.col("attachment"), F.col("named").isNull()
    return rows.select(
        *KEYS,
        place(F.col("line_no"), F.col("pos")).alias("touch_no"),
        F.coalesce(F.when(is_call, text_at(b, "$.id")).otherwise(F.col("uuid")), F.lit("")).alias("id"),
        F.when(is_call, F.coalesce(name, F.lit("")))
        .otherwise(F.coalesce(text_at(b, "$.type"), F.lit("attachment")))
        .alias("tool"),
        "attachment",
        "cwd",
        join(F.col("cwd"), F.col("named")).alias("file"),
        F.lit(False).alias("opaque"),
        (is_call & wanted).alias("wanted"),
        F.when(is_call & wanted, F.col("said")).otherwise(empty_strings()).alias("inputs"),
        F.when(is_call, empty_strings()).otherwise(F.col("said")).alias("outputs"),
    )


def results_a(lines: DataFrame) -> DataFrame:
    """``id, ord, texts`` of agent A's results, the copy kept next to the message included."""
    v, b = F.col("v"), F.col("b")
    return (
        blocks(lines.where(F.col("agent") == V.AGENT_A), F.to_json(field(v, "$.toolUseResult")).alias("copy"))
        .where(text_at(b, "$.type") == "tool_result")
        .select(
            *KEYS,
            F.coalesce(text_at(b, "$.tool_use_id"), F.lit("")).alias("id"),
            place(F.col("line_no"), F.col("pos")).alias("ord"),
            F.concat(strings(F.to_json(field(b, "$.content"))), strings(F.col("copy"))).alias("texts"),
        )
    )


def answered(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Output texts of calls. They go to the first call with their id, and to no other.

    The first call is an aggregate with partial results, not a window, so an id shared by very
    many calls stays cheap; the join's large side can be split by the skew join.
    """
    first = calls.where(~F.col("attachment") & F.col("wanted").isNotNull()).groupBy(*KEYS, "id").agg(
        F.min_by(F.struct("touch_no", "wanted"), "touch_no").alias("call")
    )
    return (
        results.join(first, [*KEYS, "id"])
        .where(F.col("call.wanted"))
        .select(
            *KEYS,
            F.col("call.touch_no").alias("touch_no"),
            F.lit("output").alias("kind"),
            "ord",
            F.posexplode("texts").alias("sub", "text"),
        )
        .select(*TEXT)
    )


def split_tables(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``touches`` and ``texts`` from extracted calls and results."""
    touches = calls.withColumn("command", F.get("inputs", F.lit(0))).select(*TOUCH)
    said = F.concat(
        F.transform("inputs", lambda t, i: F.struct(F.lit("input").alias("kind"), i.alias("sub"), t.alias("text"))),
        F.transform("outputs", lambda t, i: F.struct(F.lit("output").alias("kind"), i.alias("sub"), t.alias("text"))),
    )
    own = calls.select(*KEYS, "touch_no", F.lit(0).cast("bigint").alias("ord"), F.explode(said).alias("x")).select(
        *KEYS, "touch_no", "x.kind", "ord", "x.sub", "x.text"
    )
    return touches, own.unionByName(answered(calls, results))


# --- agent B ------------------------------------------------------------------------------


def marks_b(lines: DataFrame) -> DataFrame:
    """Narrow facts of agent B's lines, written once: ``type, ptype, itype, kind`` (call, output, item or null),
    ``owner`` — the call a line belongs to: itself, the one in progress, or the one it answers (W2, J3) —
    and ``cwd``, the folder in force (W3)."""
    v = F.col("v")
    type_, ptype = text_at(v, "$.type"), text_at(v, "$.payload.type")
    typed = lines.select(
        *KEYS,
        "line_no",
        type_.alias("type"),
        ptype.alias("ptype"),
        text_at(v, "$.payload.item.type").alias("itype"),
        text_at(v, "$.payload.call_id").alias("call_id"),
        text_at(v, "$.payload.id").alias("own_id"),
        text_at(v, "$.payload.cwd").alias("named"),
    )
    typed = typed.withColumn(
        "kind",
        first_of(
            ((F.col("type") == "response_item") & F.col("ptype").isin(*V.B_CALLS), F.lit("call")),
            ((F.col("type") == "response_item") & F.col("ptype").isin(*V.B_OUTPUTS), F.lit("output")),
            ((F.col("type") == "event_msg") & (F.col("ptype") == "item_completed"), F.lit("item")),
        ),
    )
    is_call, is_output = F.col("kind") == "call", F.col("kind") == "output"
    own = F.when(is_call, F.coalesce("call_id", "own_id")).when(is_output, F.col("call_id"))
    meta = F.when(F.col("type") == "session_meta", F.struct(F.col("named").alias("cwd")))
    narrow = cut_lineage(typed.select(*KEYS, "line_no", "type", "ptype", "itype", "kind", "named", own.alias("own"), meta.alias("meta")))
    # A call opens, any output closes; a turn's folder holds until the next turn's.
    state = F.when(is_call, F.struct(F.col("own").alias("id"))).when(is_output, F.struct(F.lit(None).cast("string").alias("id")))
    moved = F.when(F.col("type") == "turn_context", path_of_url(F.col("named")))
    carried = carry_forward(narrow, KEYS, "line_no", {"running": state, "folder": moved}, before=True)
    started = narrow.groupBy(*KEYS).agg(
        F.min_by("meta", F.when(F.col("meta").isNotNull(), F.col("line_no"))).alias("first_meta")
    )
    return cut_lineage(
        carried.join(started, KEYS).select(
            *KEYS,
            "line_no",
            "type",
            "ptype",
            "itype",
            "kind",
            F.when(F.col("kind") == "item", F.col("running.id")).otherwise(F.col("own")).alias("owner"),
            F.coalesce("folder", "first_meta.cwd", F.lit("/")).alias("cwd"),
        )
    )


def with_owner(lines: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Agent B's lines with their marks: one join on (session, line), spread evenly whatever the session sizes."""
    marks = marks_b(lines) if marks is None else marks
    return lines.join(marks, [*KEYS, "line_no"])


_CALL = (
    "array<struct<sub:int,tool:string,path:string,opaque:boolean,wanted:boolean,"
    "inputs:array<string>,outputs:array<string>>>"
)


def _touch(sub: Column, tool: Column, path=None, opaque=None, wanted=None, inputs=None, outputs=None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        sub.cast("int").alias("sub"),
        tool.alias("tool"),
        (null("string") if path is None else path).alias("path"),
        (F.lit(False) if opaque is None else opaque).alias("opaque"),
        (null("boolean") if wanted is None else wanted).alias("wanted"),
        (empty_strings() if inputs is None else inputs).alias("inputs"),
        (empty_strings() if outputs is None else outputs).alias("outputs"),
    )


def calls_b(lines: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Agent B's calls, commands, reads and changes in one pass: each line yields its touches as an array."""
    owned = with_owner(lines.where(F.col("agent") == V.AGENT_B)) if owned is None else owned
    rows = owned.where(F.col("owner").isNotNull() & F.col("kind").isin("call", "item"))
    v, is_call = F.col("v"), F.col("kind") == "call"
    item = lambda path: f"$.payload.item{path}"
    name = F.coalesce(text_at(v, "$.payload.name"), F.col("ptype"))
    tool = F.when(F.startswith(name, F.lit("mcp")) | F.contains(name, F.lit("__")), F.lit("mcp__codex")).otherwise(name)
    said = F.concat(*[strings(F.to_json(field(v, f"$.payload.{k}"))) for k in ("input", "arguments", "action")])
    # Patches come before the script they are in; a command before the files it read.
    edits = lambda paths, tool_, base: F.transform(paths, lambda p, i: _touch(i + base, F.lit(tool_), path=p))

    def script_touches(texts: Column) -> Column:
        script = F.array_join(texts, "\n")
        return let(
            script,
            lambda s: F.concat(
                edits(patched_files(s), "Edit", 0),
                F.array(
                    _touch(
                        F.lit(2**30),
                        tool,
                        opaque=F.contains(s, F.lit("tools.")) & unknown_script_tool(s),
                        wanted=F.lit(True),
                        inputs=F.flatten(F.transform(texts, without_patches)),
                    )
                ),
            ),
        )

    words = items_at(v, item(".command"))
    command = F.coalesce(text_at(F.element_at(F.concat(F.array(F.lit(None).cast("variant")), words), -1), "$"), F.lit(""))
    reads = F.filter(
        F.transform(
            F.filter(items_at(v, item(".parsed_cmd")), lambda r: text_at(r, "$.type") == "read"),
            lambda r: text_at(r, "$.path"),
        ),
        lambda p: p.isNotNull(),
    )
    ran = F.concat(
        F.array(
            _touch(
                F.lit(0),
                F.lit("Bash"),
                inputs=F.array(command),
                outputs=strings(F.to_json(field(v, item(".aggregated_output")))),
            )
        ),
        edits(F.coalesce(reads, empty_strings()), "Read", 1),
    )
    changed = edits(F.coalesce(F.map_keys(members_at(v, item(".changes"))), empty_strings()), "Edit", 0)
    itype = text_at(v, item(".type"))
    every = first_of(
        (is_call, let(said, script_touches).cast(_CALL)),
        (itype == "CommandExecution", ran.cast(_CALL)),
        (itype == "FileChange", changed.cast(_CALL)),
    )
    here = F.when(is_call, F.col("cwd")).otherwise(F.coalesce(path_of_url(text_at(v, item(".cwd"))), F.col("cwd")))
    return rows.select(*KEYS, "line_no", F.col("owner").alias("id"), here.alias("cwd"), F.explode(every).alias("t")).select(
        *KEYS,
        place(F.col("line_no"), F.col("t.sub")).alias("touch_no"),
        "id",
        "t.tool",
        F.lit(False).alias("attachment"),
        "cwd",
        join(F.col("cwd"), F.col("t.path")).alias("file"),
        "t.opaque",
        "t.wanted",
        "t.inputs",
        "t.outputs",
    )


def results_b(owned: DataFrame) -> DataFrame:
    """``id, ord, texts`` of agent B's call outputs."""
    return owned.where((F.col("kind") == "output") & F.col("owner").isNotNull()).select(
        *KEYS,
        F.col("owner").alias("id"),
        place(F.col("line_no"), F.lit(0)).alias("ord"),
        strings(F.to_json(field(F.col("v"), "$.payload.output"))).alias("texts"),
    )


def extracted(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of all lines, whichever agent wrote them."""
    owned = with_owner(lines.where(F.col("agent") == V.AGENT_B))
    calls = calls_a(lines).unionByName(calls_b(lines, owned))
    return calls, results_a(lines).unionByName(results_b(owned))


def touches(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Touches and texts of all lines."""
    return split_tables(*extracted(lines))


def touches_a(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_tables(calls_a(lines), results_a(lines))


def touches_b(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    owned = with_owner(lines.where(F.col("agent") == V.AGENT_B))
    return split_tables(calls_b(lines, owned), results_b(owned))


def connected_servers(lines: DataFrame) -> DataFrame:
    """``server`` names per session: cleaned, at most 60 characters, distinct."""
    v, b = F.col("v"), F.col("b")
    used_a = (
        blocks(lines.where(F.col("agent") == V.AGENT_A))
        .where((text_at(b, "$.type") == "tool_use") & F.startswith(text_at(b, "$.name"), F.lit("mcp__")))
        .select(*KEYS, F.split_part(F.substr(text_at(b, "$.name"), F.lit(6)), F.lit("__"), F.lit(1)).alias("server"))
    )
    ptype = text_at(v, "$.payload.type")
    used_b = lines.where((F.col("agent") == V.AGENT_B) & (text_at(v, "$.type") == "event_msg")).select(
        *KEYS,
        F.when(
            (ptype == "item_completed") & (text_at(v, "$.payload.item.type") == "McpToolCall"),
            text_at(v, "$.payload.item.server"),
        )
        .when(F.startswith(ptype, F.lit("mcp_tool_call")), text_at(v, "$.payload.invocation.server"))
        .alias("server"),
    )
    return (
        used_a.unionByName(used_b)
        .select(*KEYS, F.left(F.regexp_replace("server", "[^A-Za-z0-9_.-]", ""), F.lit(60)).alias("server"))
        .where(F.length("server") > 0)
        .distinct()
    )
