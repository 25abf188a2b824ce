"""The sender's job: what of each session may leave, and the cleaned result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.jsontext import strings
from ..functions.let import any_of, first_of
from ..functions.paths import (
    ancestors,
    credential_path,
    file_name,
    filter_on,
    inside,
    join,
    normalize,
    parent,
    shown,
    under,
)
from ..functions.text import plain
from ..operators import clean as cleaning
from ..operators import files as file_checks
from ..operators import judge as judging
from ..operators import neutral as neutrals
from ..operators import reports
from ..operators.scrub import scrub_context
from ..operators.touches import KEYS, connected_servers, extracted, split_tables
from ..session import cut_lineage
from ..sources.sessions import session_facts

SOURCES = ["touched", "received", "manifest", "instruction", "skill", "outside skill"]


@dataclass
class Corpus:
    """Inputs of a run. Only ``lines``, ``sessions`` and ``files`` are required.

    lines      project_id, session_id, agent, line_no, raw, v
    sessions   project_id, session_id, agent, root, home, cwd, off ARRAY<STRING>, no_skills
    files      project_id, path, real_path, is_file, size, content
    repos / ignored / excluded / received(project_id, rel) / identity(project_id, position, word, replacement)
    subagents  project_id, session_id, sub_session_id, tool_use_id, description
    sub_lines  the helper agents' lines; their session_id is the sub_session_id
    """

    lines: DataFrame
    sessions: DataFrame
    files: DataFrame
    repos: DataFrame | None = None
    ignored: DataFrame | None = None
    excluded: DataFrame | None = None
    received: DataFrame | None = None
    identity: DataFrame | None = None
    subagents: DataFrame | None = None
    sub_lines: DataFrame | None = None


@dataclass
class Plan:
    """Tables a run produces, all keyed by (project_id, session_id)."""

    withhold: DataFrame
    shared: DataFrame
    skipped: DataFrame
    left_out: DataFrame
    outside_skills: DataFrame
    echoes: DataFrame
    clean_lines: DataFrame
    counters: DataFrame
    neutral: DataFrame
    manifest: DataFrame


def named_in_corpus(corpus: Corpus, named: DataFrame) -> DataFrame:
    """Files whose content must be looked at: named by a call, received, or steering the build or the agent."""
    f = corpus.files
    by_name = file_name(F.col("path")).isin(*V.MANIFESTS, *V.INSTRUCTION_FILES) | any_of(
        *[F.contains("path", F.lit(f"/{r}/")) for r in V.SKILL_ROOTS], F.contains("path", F.lit("/skills/"))
    )
    wanted = named.select("project_id", normalize(F.col("path")).alias("path"))
    if corpus.received is not None:
        roots = corpus.sessions.select("project_id", "root").distinct()
        wanted = wanted.unionByName(
            corpus.received.join(roots, "project_id").select("project_id", join(F.col("root"), F.col("rel")).alias("path"))
        )
    # A name may be a link: the file behind it is looked at as well, under its own path.
    real = F.coalesce("real_path", "path")
    behind = f.join(wanted.distinct(), ["project_id", "path"], "left_semi").select("project_id", real.alias("path"))
    mentioned = wanted.unionByName(behind).distinct().withColumn("_named", F.lit(True))
    return f.join(mentioned, ["project_id", "path"], "left").where(F.col("_named") | by_name).drop("_named")


def _checked(df: DataFrame, facts: DataFrame, corpus: Corpus) -> DataFrame:
    return file_checks.check_files(df, facts, corpus.excluded)


def received_files(corpus: Corpus, facts: DataFrame) -> DataFrame:
    """Files that arrived earlier travel on."""
    at = corpus.sessions.join(corpus.received, "project_id").select(
        *KEYS, "root", "home", "off", join(F.col("root"), F.col("rel")).alias("path")
    )
    return _checked(at, facts, corpus).where("is_file")


def build_manifests(corpus: Corpus, facts: DataFrame, shared: DataFrame) -> DataFrame:
    """Build files at the root and in every folder above a shared file."""
    dirs = shared.select(*KEYS, F.explode(ancestors(F.col("rel"))).alias("dir")).unionByName(
        corpus.sessions.select(*KEYS, F.lit("").alias("dir"))
    )
    names = F.array(*[F.lit(m) for m in V.MANIFESTS])
    at = dirs.distinct().join(corpus.sessions.select(*KEYS, "root", "home", "off"), KEYS).select(
        *KEYS, "root", "home", "off",
        F.explode(
            F.transform(
                names,
                lambda m: join(F.when(F.col("dir") == "", F.col("root")).otherwise(join(F.col("root"), F.col("dir"))), m),
            )
        ).alias("path"),
    )
    at = at.join(facts.where("is_file").select("project_id", "path"), ["project_id", "path"], "left_semi")
    return _checked(at, facts, corpus)


def _without_tail(tail: str):
    """A function of a folder: what is before ``tail``, or null where it does not end so."""
    return lambda a: F.when(F.endswith(a, F.lit(tail)), F.left(a, F.length(a) - len(tail)))


def steering_files(corpus: Corpus, facts: DataFrame) -> DataFrame:
    """Instruction files and skills from the session's folder up to the root."""
    cwd, root = F.col("cwd"), F.col("root")
    up = F.filter(F.concat(F.array(cwd), F.reverse(ancestors(cwd))), lambda d: under(d, root))
    folders = corpus.sessions.select(
        *KEYS, "root", "home", "off", F.explode(F.when(F.size(up) > 0, up).otherwise(F.array(root))).alias("folder")
    ).distinct()
    path = F.col("path")
    skill_homes = F.filter(
        F.flatten(
            F.array(
                *[
                    F.transform(ancestors(path), _without_tail(f"/{r}")) for r in V.SKILL_ROOTS
                ]
            )
        ),
        lambda d: d.isNotNull(),
    )
    homes = F.when(file_name(path).isin(*V.INSTRUCTION_FILES), F.concat(skill_homes, F.array(parent(path)))).otherwise(skill_homes)
    steering = facts.where("is_file").select("project_id", "path", F.explode(homes).alias("folder")).distinct()
    at = folders.join(steering, ["project_id", "folder"]).select(*KEYS, "root", "home", "off", "path").distinct()
    steers = F.when(F.startswith("rel", F.lit(".claude/")) | F.startswith("rel", F.lit(".agents/")), "skill").otherwise("instruction")
    return _checked(at, facts, corpus).withColumn("steers", steers)


def outside_skills(corpus: Corpus, facts: DataFrame, used: DataFrame, project_skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names of skills used from outside the project, their files with ``skip``)."""
    name = file_name(F.col("dir"))
    have = project_skills.select(*KEYS, F.get(F.split("rel", "/"), F.lit(2)).alias("name")).distinct()
    own = F.array_contains(F.split(F.lower("dir"), "/"), V.TOOL)
    names = (
        used.join(corpus.sessions.select(*KEYS, "root", "off", "no_skills"), KEYS)
        .where(~under(F.col("dir"), F.col("root")) & ~own)
        .withColumn("name", name)
        .where(F.col("name") != "")
        .join(have, [*KEYS, "name"], "left_anti")
    )
    inner = facts.where("is_file").select(
        "project_id", "path", "size", "key_rule", "utf16_rule", "redactions", F.explode(ancestors(F.col("path"))).alias("dir")
    )
    rel = F.concat(F.lit(V.SKILL_ROOTS[0] + "/"), F.col("name"), F.lit("/"), inside(F.col("path"), F.col("dir")))
    files = names.where(~F.coalesce("no_skills", F.lit(False))).join(inner, ["project_id", "dir"]).withColumn("rel", rel)
    if corpus.excluded is not None:
        files = files.join(corpus.excluded.select("project_id", "rel"), ["project_id", "rel"], "left_anti")
    scan = filter_on(F.col("off"), "secret-scan")
    skip = first_of(
        (credential_path(F.col("path")).isNotNull(), F.lit("sensitive: secrets file")),
        (F.col("size") > V.MAX_FILE, F.lit("over 10 MB")),
        (scan & F.col("key_rule").isNotNull(), F.concat(F.lit("sensitive: contains a "), F.col("key_rule"))),
        (scan & F.col("utf16_rule").isNotNull(), F.concat(F.lit("sensitive: UTF-16 file contains a "), F.col("utf16_rule"))),
    )
    what = F.concat(F.lit("skill "), F.col("name"), F.lit(": "), inside(F.col("path"), F.col("dir")))
    return names.select(*KEYS, "name").distinct(), files.select(
        *KEYS, "path", "rel", "size", "redactions", skip.alias("skip"), what.alias("what")
    )


def _shared_rows(df: DataFrame, source: str, steers: Column | None = None) -> DataFrame:
    return df.where(F.col("skip").isNull() & F.col("rel").isNotNull()).select(
        *KEYS, "rel", "path", "size", "redactions", F.lit(SOURCES.index(source)).alias("_rank"),
        (F.lit(None).cast("string") if steers is None else steers).alias("steers"),
    )


def _touched(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Touches and texts. The calls are written once: every later step reads them, and parsing the
    logs again for each would cost far more. Output texts stay unmaterialised; two steps read them."""
    calls, results = extracted(lines)
    return split_tables(cut_lineage(calls), results)


def plan(corpus: Corpus) -> Plan:
    """Judge every session of the corpus and clean it."""
    t, x = _touched(corpus.lines)
    # Finding the paths in commands costs much; the contents, the checks and all that builds on them read them.
    named = cut_lineage(judging.named_paths(t, x, corpus.sessions))
    sub_named = None
    if corpus.subagents is not None and corpus.sub_lines is not None:
        st, sx = _touched(corpus.sub_lines)
        parents = corpus.subagents.select(
            "project_id", F.col("sub_session_id").alias("session_id"), F.col("session_id").alias("_parent")
        ).distinct()
        sub_sessions = parents.join(
            corpus.sessions.withColumnRenamed("session_id", "_parent"), ["project_id", "_parent"]
        )
        sub_named = cut_lineage(judging.named_paths(st, sx, sub_sessions))

    every_named = named.select("project_id", "path")
    if sub_named is not None:
        every_named = every_named.unionByName(sub_named.select("project_id", "path"))
    contents = cut_lineage(
        file_checks.content_facts(named_in_corpus(corpus, every_named)).select(
            "project_id", "path", "key_rule", "utf16_rule", "redactions", "text", "clean", "values"
        )
    )
    facts = cut_lineage(file_checks.file_facts(corpus.files, corpus.repos, corpus.ignored, contents))

    checked = cut_lineage(judging.checked_paths(named, facts, corpus.excluded))
    verdicts = judging.judge(t, x, checked, corpus.sessions)
    labels = cut_lineage(judging.labelled(verdicts, t, corpus.sessions))
    own = judging.withheld(labels)
    brief, skipped = judging.brief_labels(labels), judging.skipped_things(labels)
    echoes = judging.learned_values(labels.select(*KEYS, "touch_no", "reason"), t, x, corpus.files)

    subs = None
    passed = checked.where(F.col("shared").isNotNull()).select(*KEYS, F.col("shared").alias("path"))
    all_checked = checked.select(*KEYS, "path")
    if sub_named is not None:
        sub_checked = cut_lineage(judging.checked_paths(sub_named, facts, corpus.excluded))
        sub_verdicts = cut_lineage(judging.judge(st, sx, sub_checked, sub_sessions))
        subs = judging.subagent_reasons(sub_verdicts, corpus.subagents)
        up = lambda df: df.withColumnRenamed("session_id", "sub_session_id").join(
            corpus.subagents.select("project_id", "sub_session_id", "session_id").distinct(), ["project_id", "sub_session_id"]
        ).drop("sub_session_id")
        passed = passed.unionByName(
            up(sub_checked.where(F.col("shared").isNotNull()).select(*KEYS, F.col("shared").alias("path"))).select(*KEYS, "path")
        )
        all_checked = all_checked.unionByName(up(sub_checked.select(*KEYS, "path")).select(*KEYS, "path"))
        echoes = echoes.unionByName(up(judging.learned_values(sub_verdicts, st, sx, corpus.files)).select(*KEYS, "value"))
        skipped = skipped.unionByName(
            subs.select(*KEYS, plain(F.concat(F.lit("subagent: "), F.col("description"))).alias("what"), "reason")
        )
        told = subs.groupBy(*KEYS, "id").agg(F.max("reason").alias("reason")).select(
            *KEYS, "id", F.lit("a helper agent's summary").alias("thing"), "reason"
        )
        brief = brief.join(told, [*KEYS, "id"], "left_anti").unionByName(told)

    # Files: every source, the later one wins where several bring the same path.
    sessions = corpus.sessions.select(*KEYS, "root", "home", "off")
    touched = _checked(passed.distinct().join(sessions, KEYS), facts, corpus)
    parts = [_shared_rows(touched, "touched")]
    notes = []
    if corpus.received is not None:
        arrived = received_files(corpus, facts)
        parts.append(_shared_rows(arrived, "received"))
        notes.append(arrived)
    before = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    parts.append(_shared_rows(build_manifests(corpus, facts, before), "manifest"))
    steering = steering_files(corpus, facts)
    parts.append(_shared_rows(steering, "instruction", F.col("steers")))
    notes.append(steering.drop("steers"))
    for checked_files in notes:
        hot = checked_files.where(F.startswith("skip", F.lit("sensitive")))
        skipped = skipped.unionByName(
            hot.select(*KEYS, shown(F.col("path"), F.col("root"), F.col("home")).alias("what"), F.col("skip").alias("reason"))
        )
    texts = corpus.lines.where(F.contains("raw", F.lit("Base directory for this skill: "))).select(
        *KEYS, F.explode(strings(F.col("raw"))).alias("text")
    )
    used = judging.used_skills(texts, all_checked, corpus.files)
    project_skills = steering.where(F.col("skip").isNull() & (F.col("steers") == "skill"))
    skill_names, skill_files = outside_skills(corpus, facts, used, project_skills)
    parts.append(_shared_rows(skill_files, "outside skill", F.lit("skill")))
    skipped = skipped.unionByName(
        skill_files.where(F.col("skip").isNotNull()).select(*KEYS, "what", F.col("skip").alias("reason"))
    )
    # One row per label, whatever brought it up.
    skipped = cut_lineage(skipped.groupBy(*KEYS, "what").agg(F.max("reason").alias("reason")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    shared = cut_lineage(
        every.groupBy(*KEYS, "rel")
        .agg(
            F.max_by(F.struct("path", "size", "redactions"), "_rank").alias("f"),
            F.max_by("steers", F.when(F.col("steers").isNotNull(), F.col("_rank"))).alias("steers"),
            F.max("_rank").alias("_rank"),
        )
        .select(
            *KEYS, "rel", "f.path", "f.size", "f.redactions", "steers",
            F.element_at(F.array(*[F.lit(s) for s in SOURCES]), F.col("_rank") + 1).alias("source"),
        )
    )
    bodies = shared.join(contents.select("project_id", "path", "text", "clean", "values"), ["project_id", "path"], "left")
    words = _identity_words(corpus)
    bodies = bodies.join(sessions, KEYS).join(words, "project_id", "left")
    scan = filter_on(F.col("off"), "secret-scan")
    raw_bodies = corpus.files.select("project_id", "path", "content")
    final = bodies.join(raw_bodies, ["project_id", "path"], "left").select(
        *KEYS, "rel", "path", "steers", "source",
        F.when(scan, F.col("redactions")).otherwise(0).alias("redactions"),
        F.when(scan, F.col("clean")).otherwise(F.col("content")).alias("content"),
        F.octet_length(F.when(scan, F.col("clean")).otherwise(F.col("content"))).cast("bigint").alias("bytes"),
        file_checks.mentions_sender(F.col("text"), F.col("home"), F.coalesce("people", F.array().cast("array<string>"))).alias("personal"),
        F.when(scan, F.col("values")).alias("values"),
    ).where(F.col("content").isNotNull())  # what could not be read is not shared
    # Values blanked in shared files are blanked where the agent quoted them.
    echoes = echoes.unionByName(
        final.where(F.col("redactions") > 0)
        .select(*KEYS, F.explode("values").alias("value"))
        .where(F.length("value") >= V.MIN_ECHO)
    )
    echoes = cut_lineage(echoes.distinct())

    withhold = cut_lineage(judging.withhold_all(own, subs))
    context = scrub_context(corpus.sessions, corpus.identity, echoes)
    lines, counts = cleaning.clean(corpus.lines, withhold, corpus.sessions, context)
    lines = cut_lineage(neutrals.with_v(lines))
    neutral = neutrals.to_neutral(lines)
    messages = neutral.where(F.col("type") == "text").groupBy(*KEYS).agg(F.count("*").cast("bigint").alias("messages"))
    left = reports.left_out(brief, skipped)
    manifest = reports.manifests(
        corpus.sessions, session_facts(corpus.lines), messages, neutrals.estimate_tokens(lines), final,
        connected_servers(corpus.lines), corpus.excluded,
    )
    return Plan(
        withhold, final.drop("values"), skipped, left, skill_names, echoes, lines.drop("v"), counts, neutral, manifest
    )


def _identity_words(corpus: Corpus) -> DataFrame:
    """The few words that name a project's sender, as one array per project."""
    if corpus.identity is None:
        return corpus.sessions.select("project_id").distinct().withColumn("people", F.array().cast("array<string>"))
    return corpus.identity.groupBy("project_id").agg(F.collect_set("word").alias("people"))
