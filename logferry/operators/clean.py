"""Cleaned copies of session logs (K4, K5; P1, P2, P4-P6, J4-J6, J19, A1).

Input ``lines`` (project_id, session_id, agent, line_no, raw, v), ``withhold`` (id, reason per
session) and the sessions' scrubbing context. Output: ``clean_lines`` (keys, agent, line_no, raw)
with per-line counters; ``counters`` sums them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.jsontext import (
    blank_strings,
    field,
    items_at,
    json_string,
    members_at,
    names_key,
    set_members,
    text_at,
)
from ..functions.let import any_of, empty_strings, first_of, let
from ..functions.paths import filter_on
from ..functions.text import withheld_note
from ..session import cut_lineage
from .relink import resolve_removed
from .scrub import CONTEXT, Context, scrubbed_record, without_many_echoes
from .touches import KEYS, marks_b, with_owner

LINE = [*KEYS, "line_no"]
COUNTERS = ["secrets", "emails", "withheld", "images", "thinking"]


def dropped_attachment(v: Column) -> Column:
    """Attachments about the sender's account, permissions, hooks or memory."""
    named = lambda kind: any_of(*[F.contains(kind, F.lit(d)) for d in V.A_DROPPED_ATTACHMENTS])
    return F.coalesce(let(text_at(v, "$.attachment.type"), named), F.lit(False))


def _reasons_of(narrow: DataFrame, ids: Column, withhold: DataFrame) -> DataFrame:
    """Add ``why``: a map from those of a line's ids that are withheld to their reasons."""
    hits = (
        narrow.select(*LINE, F.explode(F.array_distinct(ids)).alias("id"))
        .join(withhold.select(*KEYS, "id", "reason"), [*KEYS, "id"])
        .groupBy(*LINE)
        .agg(F.map_from_entries(F.collect_list(F.struct("id", "reason"))).alias("why"))
    )
    none = F.map_from_arrays(empty_strings(), empty_strings())
    return narrow.join(hits, LINE, "left").withColumn("why", F.coalesce("why", none))


def _block_id(b: Column) -> Column:
    return F.coalesce(text_at(b, "$.id"), text_at(b, "$.tool_use_id"), F.lit(""))


def _scrubbed(edited: DataFrame, context: Context) -> DataFrame:
    """Scrub the edited records and add up the line's counters. ``told``: the line has a record. A test of the
    scrubbed text itself would be pushed below the scrubbing, and scrub every record once more."""
    rows = edited.select(
        *KEYS, "agent", "line_no", "edited", F.col("raw").isNotNull().alias("told"), "withheld", "images", "thinking"
    ).join(context.rows.select(*KEYS, *CONTEXT), KEYS)
    done = rows.withColumn("_s", scrubbed_record("edited"))
    scrubbed = done.select(
        *KEYS,
        "agent",
        "line_no",
        "told",
        F.col("_s.json").alias("raw"),
        F.col("_s.secrets").alias("secrets"),
        F.col("_s.emails").alias("emails"),
        *[F.col(c).cast("bigint").alias(c) for c in ("withheld", "images", "thinking")],
    )
    return scrubbed if context.many is None else without_many_echoes(scrubbed, context.many)


# --- agent A --------------------------------------------------------------------------------


def _thought(kind: Column) -> Column:
    return kind.isin("thinking", "redacted_thinking")


def _kind(b: Column) -> Column:
    return F.coalesce(text_at(b, "$.type"), F.lit(""))


def decide_a(lines: DataFrame, withhold: DataFrame, sessions: DataFrame) -> DataFrame:
    """What becomes of agent A's lines: ``kept``, ``why`` (the reasons that apply to them), ``links``, ``last`` (the
    id of the last withheld result) and what cleaning counts.

    No text: the narrow facts of all lines are read off once and written, then the decisions; relinking, the
    counters and the edits read those.
    """
    v = F.col("v")
    pairs = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), text_at(v, f"$.{k}").alias("uuid")) for k in V.A_LINKS]),
        lambda p: p["uuid"].isNotNull(),
    )
    facts = cut_lineage(
        lines.where(F.col("agent") == V.AGENT_A).select(
            *LINE,
            "agent",
            text_at(v, "$.uuid").alias("uuid"),
            text_at(v, "$.parentUuid").alias("parent"),
            pairs.alias("links"),
            (F.coalesce(text_at(v, "$.type").isin(*V.A_DROPPED), F.lit(False)) | dropped_attachment(v)).alias("dropped"),
            F.transform(
                items_at(v, "$.message.content"), lambda b: F.struct(_block_id(b).alias("id"), _kind(b).alias("kind"))
            ).alias("blocks"),
        )
    )
    ids = F.concat(
        F.filter(F.array("uuid"), lambda u: u.isNotNull()),
        F.coalesce(F.transform("blocks", lambda b: b["id"]), empty_strings()),
    )
    a = _reasons_of(facts.join(sessions.select(*KEYS, "off"), KEYS), ids, withhold)
    why, blocks, images_off = F.col("why"), F.col("blocks"), filter_on(F.col("off"), "pasted-images")
    considered = F.col("considered")
    count = lambda test: F.when(considered, F.coalesce(F.size(F.filter(blocks, lambda b: test(b["kind"]))), F.lit(0))).otherwise(0)
    result = lambda b: (b["kind"] == "tool_result") & F.map_contains_key(why, b["id"])
    withheld_here = F.coalesce(F.map_contains_key(why, F.col("uuid")), F.lit(False))
    a = (
        a.withColumn("withheld_line", withheld_here)
        .withColumn("considered", ~F.col("dropped") & ~F.col("withheld_line"))
        .withColumn("results", F.filter(blocks, result))
    )
    kept = considered & (blocks.isNull() | F.exists(blocks, lambda b: ~_thought(b["kind"])))
    return cut_lineage(
        a.select(
            *LINE, "agent", "off", "why", "uuid", "parent", kept.alias("kept"),
            F.when(kept, F.col("links")).alias("links"),
            F.when(F.size("results") > 0, F.element_at("results", -1)["id"]).alias("last"),
            F.when(considered, F.coalesce(F.size("results"), F.lit(0))).otherwise(F.col("withheld_line").cast("int")).alias("withheld"),
            F.when(images_off, count(lambda k: k.isin("image", "document"))).otherwise(0).alias("images"),
            count(_thought).alias("thinking"),
        )
    )


def links_a(decisions: DataFrame) -> DataFrame:
    """``line_no → relinked: map<key, target>`` for kept lines whose links name removed ones."""
    removed = decisions.where(~F.col("kept") & F.col("uuid").isNotNull()).select(*KEYS, "line_no", "uuid", "parent")
    targets, _ = resolve_removed(removed)
    return (
        decisions.select(*LINE, F.explode("links").alias("p"))
        .select(*LINE, "p.key", "p.uuid")
        .join(targets, [*KEYS, "uuid"])
        .groupBy(*LINE)
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "target"))).alias("relinked"))
    )


def _gone(decisions: DataFrame) -> DataFrame:
    """Counters of lines that go: what was taken out of them still counts."""
    zero = F.lit(0).cast("bigint")
    return decisions.where(~F.col("kept") & (F.col("withheld") + F.col("images") + F.col("thinking") > 0)).select(
        *KEYS, "agent", "line_no", F.lit(False).alias("told"), F.lit(None).cast("string").alias("raw"), zero.alias("secrets"), zero.alias("emails"),
        *[F.col(c).cast("bigint").alias(c) for c in COUNTERS[2:]],
    )


def _edited_block(b: Column, why: Column, images_off: Column) -> Column:
    """A kept block's JSON: images replaced, a withheld call's input blanked, a withheld result replaced."""
    kind = F.coalesce(text_at(b, "$.type"), F.lit(""))
    members = members_at(b, "$")
    image = F.to_json(F.struct(F.lit(V.A_IMAGE_NOTE).alias("text"), F.lit("text").alias("type")))
    note = withheld_note(F.element_at(why, _block_id(b)))
    blanked = F.to_json(set_members(members, {"input": blank_strings(F.to_json(field(b, "$.input")), note)}))
    emptied = F.to_json(
        F.map_concat(
            F.map_filter(members, lambda k, _: k != "content"),
            F.create_map(F.lit("content"), F.parse_json(json_string(note))),
        )
    )
    withheld = F.map_contains_key(why, _block_id(b))
    return first_of(
        (images_off & kind.isin("image", "document"), image),
        (withheld & (kind == "tool_use"), blanked),
        (withheld & (kind == "tool_result"), emptied),
    ).otherwise(F.to_json(b))


def clean_a(lines: DataFrame, withhold: DataFrame, sessions: DataFrame, context: Context) -> DataFrame:
    """Agent A's cleaned lines: bookkeeping, thinking and withheld attachments gone, withheld calls blanked,
    private fields removed, links re-pointed, every string scrubbed (K4)."""
    decisions = decide_a(lines, withhold, sessions)
    # The texts are moved once, to join what is decided about them.
    kept = (
        lines.where(F.col("agent") == V.AGENT_A)
        .select(*LINE, "raw", "v")
        .join(decisions.where("kept").drop("uuid", "parent", "links", "kept"), LINE)
        .join(links_a(decisions), LINE, "left")
    )
    v, why, images_off = F.col("v"), F.col("why"), filter_on(F.col("off"), "pasted-images")
    kept_blocks = F.filter(items_at(v, "$.message.content"), lambda b: ~_thought(_kind(b)))
    changed = (F.col("thinking") + F.col("images") > 0) | (F.size("why") > 0)
    content = F.when(
        changed,
        F.concat(
            F.lit("["), F.array_join(F.transform(kept_blocks, lambda b: _edited_block(b, why, images_off)), ","), F.lit("]")
        ),
    )
    message = F.map_filter(
        members_at(v, "$.message"), lambda k, _: ~k.isin("usage", "permissionMode", "mode")
    )
    message = F.to_json(set_members(message, {"content": content}))
    copy = F.when(F.col("last").isNotNull(), json_string(withheld_note(F.element_at(why, F.col("last")))))
    link = lambda k: F.when(
        F.map_contains_key(F.col("relinked"), F.lit(k)),
        F.coalesce(json_string(F.element_at("relinked", F.lit(k))), F.lit("null")),
    )
    top = F.map_filter(members_at(v, "$"), lambda k, _: ~k.isin("requestId", "permissionMode", "mode"))
    edited = F.to_json(
        set_members(top, {"message": message, "toolUseResult": copy, **{k: link(k) for k in V.A_LINKS}})
    )
    # Lines with nothing to edit keep their own spelling.
    touched = (
        names_key(
            F.col("raw"), [members_at(v, "$"), members_at(v, "$.message")], ["usage", "requestId", "permissionMode", "mode"]
        )
        | (F.col("thinking") + F.col("images") + F.col("withheld") > 0)
        | (F.size("why") > 0)
        | F.col("relinked").isNotNull()
    )
    rows = kept.withColumn("edited", F.when(touched, F.coalesce(edited, F.col("raw"))).otherwise(F.col("raw")))
    clean = _scrubbed(rows, context)
    return clean.unionByName(_gone(decisions))


# --- agent B --------------------------------------------------------------------------------


def decide_b(lines: DataFrame, withhold: DataFrame, sessions: DataFrame) -> DataFrame:
    """Agent B's lines with ``kept``, ``reason`` (why it is withheld, if it is) and what cleaning counts."""
    v = F.col("v")
    marks = marks_b(lines.where(F.col("agent") == V.AGENT_B))
    calls = marks.where((F.col("kind") == "call") & F.col("owner").isNotNull()).select(
        *KEYS, "owner", F.lit(True).alias("known")
    )
    reasons = withhold.groupBy(*KEYS, F.col("id").alias("owner")).agg(F.max("reason").alias("_why"))
    told = calls.distinct().join(reasons, [*KEYS, "owner"], "full")
    # Lines without a call join on a key of their own, so no null key gathers them in one task.
    marks = marks.withColumn("_owner", F.coalesce("owner", F.concat(F.lit("\u0000"), F.col("line_no")))).join(
        told.withColumnRenamed("owner", "_owner"), [*KEYS, "_owner"], "left"
    )
    b = with_owner(lines.where(F.col("agent") == V.AGENT_B), marks.drop("_owner", "cwd"))
    b = b.join(sessions.select(*KEYS, "off"), KEYS)
    kind, type_, ptype = F.col("kind"), F.coalesce("type", F.lit("")), F.coalesce("ptype", F.lit(""))
    item = F.coalesce("itype", F.lit(""))
    reasoning = (type_ == "response_item") & (ptype == "reasoning")
    developer = (type_ == "response_item") & (ptype == "message") & (
        text_at(v, "$.payload.role") == "developer"
    ).eqNullSafe(F.lit(True))
    dropped = type_.isin(*V.B_DROPPED) | ((type_ == "event_msg") & ptype.isin(*V.B_DROPPED_EVENTS))
    untraced = first_of(
        (
            kind == "item",
            ~item.isin(*V.B_KNOWN_ITEMS) | (F.col("owner").isNull() & ~item.isin("UserMessage", "AgentMessage")),
        ),
        (kind == "output", F.col("known").isNull()),
    ).otherwise(F.lit(False))
    images = F.when(
        filter_on(F.col("off"), "pasted-images") & (type_ == "response_item") & (ptype == "message"),
        F.coalesce(
            F.size(F.filter(items_at(v, "$.payload.content"), lambda p: text_at(p, "$.type") == "input_image")), F.lit(0)
        ),
    ).otherwise(0)
    kept = ~dropped & ~reasoning & ~developer
    b = b.withColumn("kept", kept).withColumn("reason", F.when(untraced, F.lit(V.UNTRACED)).otherwise(F.col("_why")))
    return b.select(
        *KEYS, "agent", "line_no", "raw", "v", "type", "ptype", "kind", "owner", "off", "kept",
        F.when(kept, F.col("reason")).alias("reason"),
        (reasoning & ~dropped).cast("int").alias("thinking"),
        F.when(kept, images).otherwise(0).alias("images"),
        (F.col("kept") & F.col("reason").isNotNull() & (kind == "output").eqNullSafe(F.lit(True))).cast("int").alias("withheld"),
    )


def clean_b(lines: DataFrame, withhold: DataFrame, sessions: DataFrame, context: Context) -> DataFrame:
    """Agent B's cleaned lines: usage, reasoning and developer messages gone, withheld and untraced
    records blanked, private fields removed, every string scrubbed (K5)."""
    decided = decide_b(lines, withhold, sessions)
    v, kind, type_ = F.col("v"), F.col("kind"), F.col("type")
    payload = F.map_filter(members_at(v, "$.payload"), lambda k, _: ~k.isin(*V.B_PRIVATE))
    note = withheld_note(F.col("reason"))
    why = F.col("reason").isNotNull()
    told = lambda text: F.to_json(F.array(F.struct(text.alias("text"), F.lit("input_text").alias("type"))))
    blanked = lambda k: F.when(
        why & (type_ == "response_item") & ~(kind == "output").eqNullSafe(F.lit(True)),
        blank_strings(F.to_json(field(v, f"$.payload.{k}")), note),
    )
    image = F.to_json(F.struct(F.lit(V.B_IMAGE_NOTE).alias("text"), F.lit("input_text").alias("type")))
    content = F.when(
        F.col("images") > 0,
        F.concat(
            F.lit("["),
            F.array_join(
                F.transform(
                    items_at(v, "$.payload.content"),
                    lambda p: F.when(text_at(p, "$.type") == "input_image", image).otherwise(F.to_json(p)),
                ),
                ",",
            ),
            F.lit("]"),
        ),
    )
    changes = {
        "output": F.when(why & (kind == "output"), told(note)),
        "input": blanked("input"),
        "arguments": blanked("arguments"),
        "action": blanked("action"),
        "item": F.when(why & (kind == "item"), blank_strings(F.to_json(field(v, "$.payload.item")), note)),
        "content": content,
    }
    edited = F.to_json(set_members(members_at(v, "$"), {"payload": F.to_json(set_members(payload, changes))}))
    private = names_key(F.col("raw"), [members_at(v, "$.payload")], V.B_PRIVATE)
    touched = private | why | (F.col("images") > 0)
    rows = decided.where("kept").withColumn(
        "edited", F.when(touched, F.coalesce(edited, F.col("raw"))).otherwise(F.col("raw"))
    )
    clean = _scrubbed(rows, context)
    return clean.unionByName(_gone(decided))


def clean(lines: DataFrame, withhold: DataFrame, sessions: DataFrame, context: Context) -> tuple[DataFrame, DataFrame]:
    """(clean lines, counters per session) for both agents."""
    every = clean_a(lines, withhold, sessions, context).unionByName(clean_b(lines, withhold, sessions, context))
    return every.where("told").select(*KEYS, "agent", "line_no", "raw"), counters(every)


def counters(cleaned: DataFrame) -> DataFrame:
    """Cleaning counters per session (A1)."""
    return cleaned.groupBy(*KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTERS])
