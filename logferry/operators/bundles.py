"""Audits of incoming bundles (K12; P25, P26, H23, J20, S8, S13).

``entries``: bundle_id, path, entry_type, size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.let import first_of
from ..functions.paths import agent_config, safe_name

REQUIRED = {"manifest.json": "no manifest", "transcript.jsonl": "no transcript"}
KNOWN = [*REQUIRED, "conversation.jsonl"]


def entry_problem(path: Column, entry_type: Column, size: Column, file_limit: int = V.HARD_MAX_FILE) -> Column:
    """Why one entry makes its bundle unacceptable, or null (P25)."""
    rel = F.when(F.startswith(path, F.lit("files/")), F.substr(path, F.lit(7)))
    return first_of(
        (entry_type != "file", F.lit("a link or special file")),
        (rel.isNotNull() & (size > file_limit), F.lit("an oversized file")),
        (path.isin(*KNOWN), F.lit(None).cast("string")),
        (rel.isNull() & (path != "files"), F.lit("unexpected entry")),
        (F.exists(F.split(rel, "/"), lambda c: c == ".."), F.lit("unsafe path")),
        (agent_config(rel).isNotNull(), F.concat(F.lit("carries "), agent_config(rel))),
    )


def checked_entries(entries: DataFrame, file_limit: int = V.HARD_MAX_FILE) -> DataFrame:
    return entries.withColumn("problem", entry_problem(F.col("path"), F.col("entry_type"), F.col("size"), file_limit))


def audit_bundles(entries: DataFrame, total_limit: int = V.MAX_BUNDLE, file_limit: int = V.HARD_MAX_FILE) -> DataFrame:
    """One row per bundle: ``accepted``, the first problem, sizes. A single bad entry refuses the bundle."""
    rows = checked_entries(entries, file_limit)
    bad = F.col("problem").isNotNull()
    has = lambda name: F.max((F.col("path") == name).cast("int")) == 1
    sums = rows.groupBy("bundle_id").agg(
        F.count("*").alias("entries"),
        F.sum("size").cast("bigint").alias("bytes"),
        F.count_if(bad).alias("bad_entries"),
        F.min_by("problem", F.when(bad, F.col("path"))).alias("entry_problem"),
        *[has(name).alias(f"_{i}") for i, name in enumerate(REQUIRED)],
    )
    problem = F.coalesce(
        F.when(F.col("bytes") > total_limit, "unpacks to more than the limit"),
        F.col("entry_problem"),
        *[F.when(~F.col(f"_{i}"), text) for i, text in enumerate(REQUIRED.values())],
    )
    return sums.select(
        "bundle_id", "entries", "bytes", "bad_entries", problem.alias("problem"), problem.isNull().alias("accepted")
    )


def accepted_files(entries: DataFrame, audit: DataFrame) -> DataFrame:
    """``bundle_id, rel, size`` of the project files of accepted bundles."""
    good = audit.where("accepted").select("bundle_id")
    return (
        entries.where(F.startswith("path", F.lit("files/")))
        .join(good, "bundle_id", "left_semi")
        .select("bundle_id", F.substr(F.col("path"), F.lit(7)).alias("rel"), "size")
    )


def without_grants(text: Column) -> Column:
    """A skill's text without ``allowed-tools`` in its front matter."""
    parts = r"(?s)^---\r?\n(.*?)\n(---.*)\z"
    head = F.regexp_extract(text, parts, 1)
    tail = F.regexp_extract(text, parts, 2)
    # Lines of the front matter, then a grant and the indented or blank lines that continue it go.
    lines = F.concat(F.regexp_replace(head, r"\r(?=\n|\z)", ""), F.lit("\n"))
    granted = F.regexp_replace(lines, r"(?im)^allowed[-_]tools[^\n]*\n(?:(?:[ \t][^\n]*|[ \t\r]*)\n)*+", "")
    return F.when(F.rlike(text, F.lit(parts)), F.concat(F.lit("---\n"), granted, tail)).otherwise(text)


def skill_path(rel: Column) -> Column:
    """Whether a project file belongs to a skill."""
    return F.startswith(rel, F.lit(V.SKILL_ROOTS[0] + "/")) | F.startswith(rel, F.lit(V.SKILL_ROOTS[1] + "/"))


def unpacked(files: DataFrame) -> DataFrame:
    """Files as written on the receiver's side: ``bundle_id, rel, text`` plus, for skills, a copy where
    the target ``agent`` looks for them unless the bundle brings one (J20)."""
    rows = files.withColumn("text", F.when(skill_path(F.col("rel")), without_grants(F.col("text"))).otherwise(F.col("text")))
    a_root, b_root = V.SKILL_ROOTS
    moved = F.when(F.col("agent") == V.AGENT_B, F.regexp_replace("rel", "^" + a_root.replace(".", r"\.") + "/", b_root + "/")).otherwise(
        F.regexp_replace("rel", "^" + b_root.replace(".", r"\.") + "/", a_root + "/")
    )
    copies = rows.withColumn("_to", moved).where(skill_path(F.col("rel")) & (F.col("_to") != F.col("rel")))
    copies = copies.withColumn("rel", F.col("_to")).drop("_to")
    return rows.unionByName(copies.join(rows.select("bundle_id", "rel"), ["bundle_id", "rel"], "left_anti"))


def received_list(files: DataFrame) -> DataFrame:
    """``bundle_id, rel``: what arrived, to be passed on when the folder is shared again."""
    return files.select("bundle_id", "rel").distinct()


def received_files(lists: DataFrame) -> DataFrame:
    """``project_id, rel`` from received-file lists (``project_id, json``)."""
    return lists.select(
        "project_id", F.explode(F.from_json(F.get_json_object("json", "$.files"), "array<string>")).alias("rel")
    ).where(F.col("rel").isNotNull())


def folder_names(manifests: DataFrame) -> DataFrame:
    """``name`` to unpack under: the sender's only when it is one plain folder name."""
    name = F.col("name")
    return manifests.withColumn("folder_name", F.when(safe_name(name), name).otherwise("pod"))
