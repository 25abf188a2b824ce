"""Reading session logs: lines, discovery, thread names, subagents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import values as V
from ..functions.jsontext import items_at, text_at, true_at
from ..functions.let import let
from ..functions.paths import encoded_folder, file_name
from ..functions.text import session_id_of, strip_intro
from ..session import cut_lineage

KEYS = ["project_id", "session_id"]


#: Rows of a one-row-a-split or one-row-a-file table up to which it is sent to every executor (some 200 bytes each).
SMALL_ROWS = 200_000


def _with_small(rows: DataFrame, table: DataFrame, on: list[str], limit: int | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each split or file.

    The table is written and counted first: up to ``SMALL_ROWS`` rows it is broadcast and ``rows``,
    which hold the texts, stay where they were read; a larger one is joined by a shuffle.
    """
    table = cut_lineage(table)
    few = table.count() <= (SMALL_ROWS if limit is None else limit)
    return rows.join(F.broadcast(table) if few else table, on, how)


def read_numbered(spark: SparkSession, path: str, limit: int | None = None, **options: str) -> DataFrame:
    """``file, line_no, raw, complete, modified, _last`` of JSON-lines files, blank lines included.

    Files are read in splits, so one file may be larger than a task's memory. A first pass makes one
    row a split: its number of lines and where its task began to count them. A line's number is its
    place after that plus the lines of the file's earlier splits, so no text is shuffled. The second
    pass must meet the same splits in the same tasks; where a line's place lies outside its split's
    lines, or its split has no row, the job fails instead of giving wrong numbers.
    ``complete`` tells whether the file ends with a new line: then its lines plus one byte each add
    up to its size. ``_last`` is the number of the last line that is not blank.
    """
    rows = (
        spark.read.options(lineSep="\n", **options)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("_metadata.file_block_length").alias("length"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.regexp_replace("value", r"\r\z", "").alias("raw"),
            F.octet_length("value").alias("bytes"),
            F.monotonically_increasing_id().alias("seq"),
        )
        .withColumn("task", F.shiftright("seq", 33))
    )
    key = ["file", "split", "length", "task"]
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    filled = F.length(F.trim("raw")) > 0
    offset = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    splits = (
        rows.groupBy(*key)
        .agg(
            F.count("*").alias("n"),
            F.min("seq").alias("first"),
            F.max(F.when(filled, F.col("seq"))).alias("filled"),
            F.sum(F.col("bytes") + 1).alias("bytes"),
            F.first("size").alias("size"),
        )
        .withColumn("offset", offset)
        .select(
            *key,
            "n",
            "first",
            "offset",
            F.max(F.col("offset") + F.col("filled") - F.col("first")).over(whole).alias("_last"),
            # A byte-order mark (3 bytes) is not part of the first line.
            (F.col("size") - F.sum("bytes").over(whole)).isin(0, 3).alias("complete"),
        )
    )
    place = F.col("seq") - F.col("first")
    moved = F.raise_error(F.concat(F.col("file"), F.lit(": its splits changed between two passes"))).cast("bigint")
    return _with_small(rows, splits, key, limit, "left").select(
        "file",
        F.when((place >= 0) & (place < F.col("n")), F.col("offset") + place).otherwise(moved).alias("line_no"),
        "raw",
        "complete",
        "modified",
        "_last",
    )


def parsed(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good lines with ``v``, bad lines). Blank lines go; an unfinished last line is not bad."""
    rows = _judged(numbered)
    good = rows.where(F.col("v").isNotNull()).drop("_bad", "complete", "_last")
    bad = rows.where("_bad").select("file", (F.col("line_no") + 1).alias("line"), "raw", F.lit("not valid JSON").alias("problem"))
    return good, bad


def parsed_or_fail(numbered: DataFrame) -> DataFrame:
    """Good lines; the job fails with the file and number of a bad one."""
    rows = _judged(numbered)
    where = F.concat(F.col("file"), F.lit(" line "), (F.col("line_no") + 1).cast("string"), F.lit(": not valid JSON"))
    keep = F.when(F.col("_bad"), F.raise_error(where).cast("boolean")).otherwise(F.col("v").isNotNull())
    return rows.where(keep).drop("_bad", "complete", "_last")


def _judged(numbered: DataFrame) -> DataFrame:
    rows = numbered.where(F.length(F.trim("raw")) > 0)
    # Blank lines may follow the last real one: unfinished means nothing but blanks after it.
    unfinished = ~F.col("complete") & (F.col("line_no") == F.col("_last"))
    return rows.withColumn("v", F.try_parse_json("raw")).withColumn("_bad", F.col("v").isNull() & ~unfinished)


def read_a(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """Lines and bad lines of agent A's sessions under ``<home>/projects/<folder>/<id>.jsonl``."""
    good, bad = parsed(read_numbered(spark, f"{home}/projects/*/*.jsonl"))
    stem = F.regexp_replace(file_name(F.col("file")), r"\.jsonl\z", "")
    return (
        good.select(
            F.regexp_extract("file", r"/projects/([^/]+)/[^/]+\z", 1).alias("project_id"),
            stem.alias("session_id"),
            F.lit(V.AGENT_A).alias("agent"),
            "line_no",
            "raw",
            "v",
            "modified",
            "file",
        ),
        bad,
    )


def read_b(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """Lines and bad lines of agent B's sessions: ``rollout-*`` files at any depth under ``<home>/sessions``.

    A session belongs to the folder its first line names; one without that is not a session.
    """
    good, bad = parsed(
        read_numbered(spark, f"{home}/sessions", recursiveFileLookup="true", pathGlobFilter="rollout-*")
    )
    stem = F.regexp_replace(file_name(F.col("file")), r"\.jsonl\z", "")
    owner = good.where((F.col("line_no") == 0) & (text_at(F.col("v"), "$.type") == "session_meta")).select(
        "file", text_at(F.col("v"), "$.payload.cwd").alias("_cwd")
    )
    owner = owner.where(F.col("_cwd").isNotNull())
    return (
        _with_small(good, owner, ["file"]).select(
            encoded_folder(F.col("_cwd")).alias("project_id"),
            session_id_of(stem).alias("session_id"),
            F.lit(V.AGENT_B).alias("agent"),
            "line_no",
            "raw",
            "v",
            "modified",
            "file",
        ),
        bad,
    )


def thread_names(index_lines: DataFrame) -> DataFrame:
    """``id, thread_name`` from index lines (``line_no, raw``): later rows win, bad ones are skipped."""
    v = F.try_parse_json("raw")
    return (
        index_lines.select("line_no", text_at(v, "$.id").alias("id"), text_at(v, "$.thread_name").alias("thread_name"))
        .where(F.col("id").isNotNull() & F.col("thread_name").isNotNull())
        .groupBy("id")
        .agg(F.max_by("thread_name", "line_no").alias("thread_name"))
    )


def read_subagents(spark: SparkSession, home: str) -> DataFrame:
    """``project_id, session_id, transcript, tool_use_id, description`` from ``<session>/subagents/*.meta.json``."""
    v = F.try_parse_json("value")
    where = r"/projects/([^/]+)/([^/]+)/subagents/[^/]+\z"
    return (
        spark.read.text(f"{home}/projects/*/*/subagents/*.meta.json", wholetext=True)
        .select(
            F.regexp_extract("_metadata.file_path", where, 1).alias("project_id"),
            F.regexp_extract("_metadata.file_path", where, 2).alias("session_id"),
            F.replace("_metadata.file_path", F.lit(".meta.json"), F.lit(".jsonl")).alias("transcript"),
            text_at(v, "$.toolUseId").alias("tool_use_id"),
            F.coalesce(text_at(v, "$.description"), F.lit("")).alias("description"),
        )
        .where(F.col("tool_use_id").isNotNull())
    )


# --- titles, versions, folders -----------------------------------------------------------


def _prompt(text: Column) -> Column:
    return let(strip_intro(text), lambda t: F.when((t != "") & ~F.startswith(t, F.lit("<")), t))


def titles_a(lines: DataFrame) -> DataFrame:
    """The last AI title in the first lines, else the first real prompt; sessions without either are left out."""
    v = F.col("v")
    early = lines.where(
        (F.col("line_no") < V.TITLE_LINES[V.AGENT_A])
        & (F.contains("raw", F.lit('"ai-title"')) | F.contains("raw", F.lit('"type":"user"')))
    )
    content = F.coalesce(
        text_at(v, "$.message.content"),
        F.get(
            F.filter(
                F.transform(items_at(v, "$.message.content"), lambda b: text_at(b, "$.text")), lambda t: t.isNotNull()
            ),
            F.lit(0),
        ),
    )
    rows = early.select(
        *KEYS,
        "line_no",
        text_at(v, "$.aiTitle").alias("named"),
        F.when(~true_at(v, "$.isMeta"), _prompt(content)).alias("prompt"),
    )
    return (
        rows.groupBy(*KEYS)
        .agg(
            F.max_by("named", F.when(F.col("named").isNotNull(), F.col("line_no"))).alias("named"),
            F.min_by(
                "prompt", F.when(F.col("prompt").isNotNull() & F.col("named").isNull(), F.col("line_no"))
            ).alias("prompt"),
        )
        .select(*KEYS, F.coalesce("named", "prompt").alias("title"))
        .where(F.col("title").isNotNull())
    )


def titles_b(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The thread name, else the first user text in the first lines, else ``(untitled)``."""
    v = F.col("v")
    early = lines.where(F.col("line_no") < V.TITLE_LINES[V.AGENT_B])
    said = (text_at(v, "$.payload.type") == "message") & (text_at(v, "$.payload.role") == "user")
    rows = early.select(
        *KEYS,
        "line_no",
        F.when(said, _prompt(text_at(v, "$.payload.content[0].text"))).alias("prompt"),
        F.when(F.col("line_no") == 0, text_at(v, "$.payload.id")).alias("id"),
    )
    firsts = rows.groupBy(*KEYS).agg(
        F.min_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("line_no"))).alias("prompt"),
        F.max("id").alias("id"),
    )
    if names is None:
        return firsts.select(*KEYS, F.coalesce("prompt", F.lit("(untitled)")).alias("title"))
    return firsts.join(names, "id", "left").select(
        *KEYS, F.coalesce("thread_name", "prompt", F.lit("(untitled)")).alias("title")
    )


def session_facts(lines: DataFrame) -> DataFrame:
    """First working folder and agent version of each session (A10)."""
    v, is_a = F.col("v"), F.col("agent") == V.AGENT_A
    meta = text_at(v, "$.type") == "session_meta"
    a = lambda name: F.when(is_a, text_at(v, f"$.{name}"))
    rows = lines.select(
        *KEYS,
        "agent",
        "line_no",
        a("cwd").alias("cwd_a"),
        a("version").alias("version_a"),
        F.when(
            ~is_a & meta,
            F.struct(text_at(v, "$.payload.cwd").alias("cwd"), text_at(v, "$.payload.cli_version").alias("version")),
        ).alias("meta"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return (
        rows.groupBy(*KEYS, "agent")
        .agg(first("cwd_a").alias("cwd_a"), first("version_a").alias("version_a"), first("meta").alias("meta"))
        .select(
            *KEYS,
            "agent",
            F.coalesce("cwd_a", "meta.cwd").alias("cwd"),
            F.coalesce("version_a", "meta.version").alias("agent_version"),
        )
    )
