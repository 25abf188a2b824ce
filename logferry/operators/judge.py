"""Verdicts on tool calls: may their content leave the machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.commands import leaves_project, opaque_command, sensitive_command
from ..functions.let import first_of
from ..functions.paths import (
    credential_path,
    filter_on,
    join,
    normalize,
    paths_in,
    personal_folder,
    shown,
    skill_folder,
    system_path,
    under,
)
from ..functions.secrets import secret_values
from ..functions.text import plain, short, trimmed, without_cd
from .files import skip_reason, text_of, with_file_facts, with_limits
from .touches import KEYS

TOUCH = [*KEYS, "touch_no"]
# The order in which a touch's possible reasons count.
MCP, FILE, INPUT, OPAQUE, COMMAND, _, OUTPUT = range(7)


def _with_session(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add the session's root, home and switched-off filters."""
    return df.join(sessions.select(*KEYS, "root", "home", "off"), KEYS)


def _rank(stage: Column, *order: Column) -> Column:
    """Where a candidate reason stands: stage, then position within it."""
    spots = [stage, *order, *[F.lit(0)] * (2 - len(order))]
    return F.array(*[x.cast("bigint") for x in spots])


def _with_value(df: DataFrame, value: Column, name: str, *others: str | Column) -> DataFrame:
    """``others`` and ``value`` of the rows where it is not null. As a filter, the test would be pushed below the joins
    and projections ``value`` is made of, and work it out once more, in parts many times."""
    return df.select(*others, F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias(name))


def named_paths(touches: DataFrame, texts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Paths a touch's file and inputs name, in order: ``src`` is 'file' or 'input' (H7, H8)."""
    t = _with_session(touches, sessions)
    # Results of connected tools are withheld before any of their paths is looked at.
    t = t.where(~(F.startswith("tool", F.lit("mcp__")) & filter_on(F.col("off"), "connected-tools")))
    files = t.where(F.col("file").isNotNull()).select(
        *TOUCH, "root", "home", "off", F.lit("file").alias("src"), F.lit(0).alias("sub"), F.lit(0).alias("pos"),
        F.col("file").alias("path"),
    )
    inputs = (
        texts.where(F.col("kind") == "input")
        .join(t.select(*TOUCH, "cwd", "root", "home", "off"), TOUCH)
        .select(
            *TOUCH, "root", "home", "off", F.lit("input").alias("src"), "sub",
            F.posexplode(paths_in(F.col("text"), F.col("cwd"), F.col("home"))).alias("pos", "path"),
        )
    )
    return files.unionByName(inputs)


def checked_paths(named: DataFrame, facts: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Named paths with ``skip`` (why the file stays out), ``reason`` (why the touch is withheld) and ``shared``."""
    rows = with_limits(with_file_facts(named, facts, excluded)).withColumn("skip", skip_reason())
    root, home, off, path = (F.col(c) for c in ("root", "home", "off", "at"))
    outside_hidden = filter_on(off, "outside-project")
    skip, outside = F.col("skip"), F.lit("outside the project")
    counts = F.startswith(skip, F.lit("sensitive")) | skip.isin("gitignored", "left out by you")
    is_file = F.coalesce("is_file", F.lit(False))
    reason = first_of(
        # A named file withholds its call for any reason.
        (F.col("src") == "file", F.when((skip != outside) | outside_hidden, skip)),
        # A path in a command only when sensitive, ignored, left out, or outside.
        (is_file, F.when(counts | ((skip == outside) & outside_hidden & ~system_path(path)), skip)),
    ).otherwise(
        F.when(
            F.startswith("by_path", F.lit("sensitive")) | ((F.col("by_path") == outside) & outside_hidden & under(path, home)),
            F.col("by_path"),
        )
    )
    return rows.select(
        *named.columns,
        "skip",
        reason.alias("reason"),
        F.when(is_file & skip.isNull(), F.col("real_path")).alias("shared"),
    )


def judge(touches: DataFrame, texts: DataFrame, checked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Withheld touches with ``reason`` and ``culprit`` (the path that caused it, if any).

    Every check emits candidate rows with a rank; one aggregate keeps the lowest rank per touch,
    so a call with any number of paths or output texts is judged without collecting them.
    """
    t = _with_session(touches, sessions)
    off, root, home = F.col("off"), F.col("root"), F.col("home")
    paths = _with_value(checked, F.col("reason"), "reason", *TOUCH, "src", "sub", "pos", "path").select(
        *TOUCH,
        _rank(F.when(F.col("src") == "file", FILE).otherwise(INPUT), F.col("sub"), F.col("pos")).alias("rank"),
        "reason",
        F.col("path").alias("culprit"),
    )
    cmd = F.coalesce(F.col("command"), F.lit(""))
    unchecked = filter_on(off, "unchecked-commands")
    bash = F.col("tool") == "Bash"
    tests = [
        (MCP, F.startswith("tool", F.lit("mcp__")) & filter_on(off, "connected-tools"), V.MCP_REASON),
        (OPAQUE, F.col("opaque") & unchecked, V.OPAQUE_REASON),
        (COMMAND, bash & filter_on(off, "credential-files") & sensitive_command(cmd), V.SENSITIVE_CMD_REASON),
        (
            COMMAND + 1,
            bash & unchecked & (leaves_project(cmd, F.col("cwd"), home, root) | opaque_command(cmd)),
            V.UNCHECKED_REASON,
        ),
    ]
    # A call's own lowest-ranked reason, found in one pass over the calls.
    own = first_of(
        *[(test, F.struct(_rank(F.lit(stage)).alias("rank"), F.lit(why).alias("reason"))) for stage, test, why in tests]
    )
    calls = _with_value(t, own, "own", *TOUCH).select(
        *TOUCH, "own.rank", "own.reason", F.lit(None).cast("string").alias("culprit")
    )
    shows = texts.where(F.col("kind") == "output").join(t.select(*TOUCH, "cwd", "root", "home", "off"), TOUCH)
    sensitive = lambda p: F.concat(
        F.lit("sensitive: "),
        F.coalesce(
            F.when(filter_on(off, "personal-folders"), personal_folder(p, home)),
            F.when(filter_on(off, "credential-files"), credential_path(p)),
        ),
    )
    hits = lambda ps: F.filter(F.transform(ps, sensitive), lambda r: r.isNotNull())
    absolute = F.filter(paths_in(F.col("text"), F.col("cwd"), home), lambda p: ~under(p, root))
    searched = F.transform(
        F.filter(F.split("text", "\n", -1), lambda l: F.contains(l, F.lit(":"))),
        lambda l: join(F.col("cwd"), trimmed(F.split_part(l, F.lit(":"), F.lit(1)))),
    )
    shown_reason = F.coalesce(F.get(hits(absolute), F.lit(0)), F.get(hits(searched), F.lit(0)))
    output = _with_value(
        shows, shown_reason, "reason", *TOUCH, _rank(F.lit(OUTPUT), F.col("ord"), F.col("sub")).alias("rank")
    ).withColumn("culprit", F.lit(None).cast("string"))
    return (
        calls.unionByName(paths)
        .unionByName(output)
        .groupBy(*TOUCH)
        .agg(F.min_by(F.struct("reason", "culprit"), "rank").alias("v"))
        .select(*TOUCH, "v.reason", "v.culprit")
    )


# --- one reason and one label per call ------------------------------------------------------


def labelled(verdicts: DataFrame, touches: DataFrame, sessions: DataFrame) -> DataFrame:
    """Verdicts with their touch, the report's line ``what`` and the summary's short label ``thing``."""
    rows = _with_session(verdicts.join(touches, TOUCH), sessions)
    root, home = F.col("root"), F.col("home")
    label = F.concat(
        F.col("tool"), F.lit(": "), short(without_cd(F.coalesce(F.col("command"), F.lit(""))), 50)
    )
    what = first_of(
        (F.col("attachment"), F.concat(F.lit("attachment ("), F.col("tool"), F.lit(")"))),
        (F.col("file").isNotNull(), shown(F.col("file"), root, home)),
    ).otherwise(label)
    place_named = F.coalesce("culprit", "file")
    thing = first_of(
        (place_named.isNotNull(), shown(place_named, root, home)),
        (F.startswith("tool", F.lit("mcp__")), F.lit(V.CONNECTED)),
        (F.col("attachment"), F.lit(V.CONTEXT)),
    ).otherwise(F.lit(V.COMMAND))
    return rows.select(
        *TOUCH,
        "id",
        "reason",
        "culprit",
        "attachment",
        plain(F.translate(what, "\n", " ")).alias("what"),
        plain(thing).alias("thing"),
    )


def withheld(labels: DataFrame) -> DataFrame:
    """``id, reason, what`` — one per call: the first failing touch, but a script's own text gives way
    to the first real command it ran (W6)."""
    script = F.contains("what", F.lit("tools."))
    kept = F.min_by(F.struct("reason", "what", "touch_no"), F.struct(script, F.col("touch_no")))
    return labels.groupBy(*KEYS, "id").agg(kept.alias("k")).select(*KEYS, "id", "k.reason", "k.what", "k.touch_no")


def brief_labels(labels: DataFrame) -> DataFrame:
    """``id, thing, reason`` — one per call: the first telling label, else the last generic one."""
    generic = F.col("thing").isin(V.COMMAND, V.CONTEXT)
    order = F.struct(generic, F.when(generic, -F.col("touch_no")).otherwise(F.col("touch_no")))
    return (
        labels.groupBy(*KEYS, "id")
        .agg(F.min_by(F.struct("thing", "reason"), order).alias("k"))
        .select(*KEYS, "id", "k.thing", "k.reason")
    )


def skipped_things(labels: DataFrame) -> DataFrame:
    """``what, reason`` of the report: a later row for the same label replaces an earlier one, and a
    label dropped for a better one disappears even where another call shares it."""
    script = F.contains("what", F.lit("tools."))
    per_id = labels.groupBy(*KEYS, "id").agg(
        F.min_by(F.struct("touch_no", "what", "reason"), "touch_no").alias("first"),
        F.min_by(F.struct("touch_no", "what", "reason"), F.struct(script, F.col("touch_no"))).alias("kept"),
    )
    event = lambda who, put: F.struct(
        F.col(f"{who}.touch_no").alias("at"), F.lit(put).alias("put"), F.col(f"{who}.what").alias("what"),
        F.col(f"{who}.reason").alias("reason"),
    )
    changed = F.col("first.touch_no") != F.col("kept.touch_no")
    removal = F.struct(
        F.col("kept.touch_no").alias("at"), F.lit(0).alias("put"), F.col("first.what").alias("what"),
        F.col("first.reason").alias("reason"),
    )
    moves = F.when(changed, F.array(event("first", 1), removal, event("kept", 1))).otherwise(F.array(event("kept", 1)))
    return (
        per_id.select(*KEYS, F.explode(moves).alias("m"))
        .groupBy(*KEYS, F.col("m.what").alias("what"))
        .agg(F.max_by(F.struct("m.put", "m.reason"), F.struct("m.at", "m.put")).alias("last"))
        .where(F.col("last.put") == 1)
        .select(*KEYS, "what", "last.reason")
    )


def subagent_reasons(verdicts: DataFrame, subagents: DataFrame) -> DataFrame:
    """``session_id, id, reason, description`` for helper agents whose transcript touched something
    withheld: the parent's call with that id is withheld too (J7). ``subagents`` names the helper's
    own lines by ``sub_session_id``."""
    first = verdicts.groupBy(*KEYS).agg(F.min_by("reason", "touch_no").alias("reason"))
    first = first.select("project_id", F.col("session_id").alias("sub_session_id"), "reason")
    return subagents.join(first, ["project_id", "sub_session_id"]).select(
        *KEYS, F.col("tool_use_id").alias("id"), "reason", "description"
    )


def withhold_all(own: DataFrame, subs: DataFrame | None) -> DataFrame:
    """``id, reason`` of everything to withhold; a helper agent's reason overrides the call's own."""
    if subs is None:
        return own.select(*KEYS, "id", "reason")
    over = subs.groupBy(*KEYS, "id").agg(F.concat(F.lit("subagent "), F.max("reason")).alias("sub"))
    return own.join(over, [*KEYS, "id"], "full").select(*KEYS, "id", F.coalesce("sub", "reason").alias("reason"))


# --- secrets learned from what is withheld ------------------------------------------------------


def learned_values(
    verdicts: DataFrame, touches: DataFrame, texts: DataFrame, facts_contents: DataFrame | None = None
) -> DataFrame:
    """Distinct secret values in the texts, and in the named files, of touches withheld as sensitive."""
    hot = verdicts.where(F.contains("reason", F.lit("sensitive"))).select(*TOUCH)
    said = texts.join(hot, TOUCH, "left_semi").select(*KEYS, F.explode(secret_values(F.col("text"))).alias("value"))
    if facts_contents is not None:
        read = (
            touches.where(F.col("file").isNotNull())
            .join(hot, TOUCH, "left_semi")
            .select(*KEYS, normalize(F.col("file")).alias("path"))
            .distinct()
            .join(
                # A file answers to the path it was listed under and to the one behind its links.
                facts_contents.where(F.col("is_file") & (F.col("size") <= V.MAX_FILE)).select(
                    "project_id",
                    F.explode(F.array_distinct(F.array("path", F.coalesce("real_path", "path")))).alias("path"),
                    "content",
                ),
                ["project_id", "path"],
            )
            .select(*KEYS, F.explode(secret_values(text_of(F.col("content")))).alias("value"))
        )
        said = said.unionByName(read)
    return said.distinct()


def used_skills(lines_strings: DataFrame, checked: DataFrame, files: DataFrame) -> DataFrame:
    """Skill folders a session announced or named, that hold a SKILL.md.

    ``lines_strings`` has one ``text`` per string of the session's lines.
    """
    announced = lines_strings.where(F.contains("text", F.lit("Base directory for this skill: "))).select(
        *KEYS,
        F.explode(
            F.regexp_extract_all("text", F.lit(r"Base directory for this skill: ([^\r\n]*)"), F.lit(1))
        ).alias("dir"),
    )
    named = checked.select("project_id", "session_id", F.col("path").alias("dir"))
    folders = (
        announced.select(*KEYS, trimmed(F.col("dir")).alias("dir"))
        .unionByName(named)
        .select(*KEYS, skill_folder(F.col("dir")).alias("dir"))
        .where(F.col("dir").isNotNull())
        .distinct()
    )
    manuals = files.where("is_file").select("project_id", F.regexp_extract("path", r"^(.*)/SKILL\.md\z", 1).alias("dir"))
    return folders.join(manuals.where(F.col("dir") != "").distinct(), ["project_id", "dir"], "left_semi").select(*KEYS, "dir")
