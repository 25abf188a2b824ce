"""Project files: text decoding, content checks, ignore rules, verdicts.

``files``     project_id, path (as named), real_path, is_file, size, content BINARY
``repos``     project_id, repo, listing_ok
``ignored``   project_id, repo, entry (entries ending in ``/`` are folders)
``excluded``  project_id, rel
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.let import first_of, let
from ..functions.paths import (
    ancestors,
    distinctive,
    filter_on,
    inside,
    normalize,
    off_limits,
    portable,
    under,
)
from ..functions.secrets import any_rule_possible, first_rule, mask_emails, redact_if_needed

PROJECT = ["project_id"]


# --- bytes as text ------------------------------------------------------------------------


def utf16_kind(content: Column) -> Column:
    """``LE`` or ``BE`` for UTF-16 text, by its byte-order mark or a zero in every other byte, else null."""
    head = F.substring(content, 1, 512)
    n = F.least(F.octet_length(content), F.lit(512))
    pair_count = F.floor(n / 2)

    # Two hex digits per byte: the even and odd bytes' zeros among whole pairs.
    def zeros(odd: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.ceil((n - odd) / 2) - 1, F.lit(0)))
        return F.size(F.filter(at, lambda i: F.substring(head, i * 2 + odd + 1, F.lit(1)) == F.lit(b"\0")))

    mostly = lambda odd: (n >= 8) & F.contains(head, F.lit(b"\0")) & (zeros(odd) * 10 >= pair_count * 9)
    mark = F.substring(content, 1, 2)
    return first_of(
        (mark == F.lit(b"\xff\xfe"), F.lit("LE")),
        (mark == F.lit(b"\xfe\xff"), F.lit("BE")),
        (mostly(1), F.lit("LE")),
        (mostly(0), F.lit("BE")),
    )


def text_of(content: Column) -> Column:
    """The text of a file's bytes: UTF-16 when it looks like it, else UTF-8 with broken bytes replaced."""
    marked = F.substring(content, 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff"))
    body = F.when(marked, F.substring(content, 3, 2**31 - 1)).otherwise(content)
    whole = F.substring(body, F.lit(1), F.floor(F.octet_length(body) / 2).cast("int") * 2)
    return let(
        utf16_kind(content),
        lambda kind: first_of(
            (kind == "LE", F.decode(whole, "UTF-16LE")),
            (kind == "BE", F.decode(whole, "UTF-16BE")),
        ).otherwise(F.make_valid_utf8(content.cast("string"))),
    )


def content_facts(files: DataFrame) -> DataFrame:
    """What the rules say about each file's content, whatever a session's filters are.

    ``key_rule``   a key format in it (the file stays out whole)
    ``utf16_rule`` any rule, for UTF-16 text (it cannot be rewritten)
    ``clean``      UTF-8 text with its secrets redacted, ``redactions`` of them, ``values`` blanked
    """
    content = F.col("content")
    is_text = F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.lit(b"\0"))
    readable = F.col("is_file") & (F.col("size") <= V.HARD_MAX_FILE)
    return (
        files.withColumn("text", F.when(readable, text_of(content)))
        .withColumn("is_text", is_text)
        .withColumn("_possible", any_rule_possible(F.col("text")))
        .withColumn("key_rule", F.when(F.col("_possible"), first_rule(F.col("text"), strong_only=True)))
        .withColumn(
            "utf16_rule",
            F.when(
                F.col("_possible") & ~F.col("is_text") & utf16_kind(content).isNotNull(), first_rule(F.col("text"))
            ),
        )
        .withColumn("_r", F.when(F.col("is_text") & F.col("key_rule").isNull(), redact_if_needed(F.col("text"))))
        .withColumn("clean", F.when(F.col("_r").isNotNull(), F.to_binary(F.col("_r.text"), F.lit("utf-8"))).otherwise(content))
        .withColumn("redactions", F.coalesce(F.size("_r.found"), F.lit(0)))
        .withColumn("values", F.transform("_r.found", lambda f: f["value"]))
        .drop("_possible", "_r")
    )


# --- ignore rules ---------------------------------------------------------------------------


def ignored_files(files: DataFrame, repos: DataFrame, ignored: DataFrame) -> DataFrame:
    """``project_id, path`` of files their nearest repository ignores.

    A file is compared with its own ancestors only, so every step is an equi-join.
    """
    paths = files.select("project_id", F.col("real_path").alias("path")).distinct()
    nearest = (
        paths.select("project_id", "path", F.explode(ancestors(F.col("path"))).alias("repo"))
        .join(repos, ["project_id", "repo"])
        .groupBy("project_id", "path")
        .agg(F.max_by(F.struct("repo", "listing_ok"), F.length("repo")).alias("r"))
        .select("project_id", "path", "r.repo", "r.listing_ok")
    )
    unlisted = nearest.where(~F.col("listing_ok")).select("project_id", "path")
    inner = portable(inside(F.col("path"), F.col("repo")))
    folders = F.transform(F.filter(ancestors(inner), lambda a: a != ""), lambda a: F.concat(a, F.lit("/")))
    listed = (
        nearest.where("listing_ok")
        .select("project_id", "path", "repo", F.explode(F.concat(F.array(inner), folders)).alias("entry"))
        .join(ignored, ["project_id", "repo", "entry"], "left_semi")
        .select("project_id", "path")
        .distinct()
    )
    return unlisted.unionByName(listed)


def file_facts(
    files: DataFrame,
    repos: DataFrame | None = None,
    ignored: DataFrame | None = None,
    contents: DataFrame | None = None,
) -> DataFrame:
    """Narrow facts per named path: ``is_file, size, ignored, key_rule, utf16_rule``, without content."""
    keys = ["project_id", "path"]
    facts = files.select(*keys, F.coalesce("real_path", "path").alias("real_path"), "is_file", "size")
    if contents is None:
        contents = content_facts(files)
    facts = facts.join(contents.select(*keys, "key_rule", "utf16_rule", "redactions"), keys, "left")
    if repos is None or ignored is None:
        return facts.withColumn("ignored", F.lit(False))
    hits = ignored_files(facts, repos, ignored).select(
        "project_id", F.col("path").alias("real_path"), F.lit(True).alias("ignored")
    )
    return facts.join(hits, ["project_id", "real_path"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def with_limits(rows: DataFrame) -> DataFrame:
    """Add ``by_path`` and ``by_real``: whether a path, and the real path behind it, may be reached at all.

    Both are columns of their own, so each path is classified once however often the result is used.
    """
    root, home, off = F.col("root"), F.col("home"), F.col("off")
    return rows.withColumn("by_path", off_limits(F.col("at"), root, home, off)).withColumn(
        "by_real",
        F.when(F.col("real_path") == F.col("at"), F.col("by_path")).when(
            F.col("real_path").isNotNull(), off_limits(F.col("real_path"), root, home, off)
        ),
    )


def skip_reason() -> Column:
    """Why a named file must stay out, or null when it may be shared.

    Expects the columns of ``with_file_facts`` and ``with_limits``.
    """
    root, off = F.col("root"), F.col("off")
    return first_of(
        (F.startswith("by_path", F.lit("sensitive")), F.col("by_path")),
        (
            F.col("is_file").isNull(),
            F.when(under(F.col("at"), root), "no longer exists").otherwise("outside the project"),
        ),
        (F.col("by_real").isNotNull(), F.col("by_real")),
        (inside(F.col("real_path"), root).isNull(), F.lit("outside the project")),
        (F.coalesce(F.col("excluded"), F.lit(False)), F.lit("left out by you")),
        (F.col("ignored") & filter_on(off, "gitignored"), F.lit("gitignored")),
        (~F.col("is_file"), F.lit("no longer exists")),
        ((F.col("size") > V.MAX_FILE) & filter_on(off, "large-files"), F.lit("over 10 MB")),
        (F.col("size") > V.HARD_MAX_FILE, F.lit("over 1 GB")),
        (
            filter_on(off, "secret-scan") & F.col("key_rule").isNotNull(),
            F.concat(F.lit("sensitive: contains a "), F.col("key_rule")),
        ),
        (
            filter_on(off, "secret-scan") & F.col("utf16_rule").isNotNull(),
            F.concat(F.lit("sensitive: UTF-16 file contains a "), F.col("utf16_rule")),
        ),
    )


def with_file_facts(named: DataFrame, facts: DataFrame, excluded: DataFrame | None) -> DataFrame:
    """``named`` rows (project_id, path, root …) with their file's facts and whether the user left it out."""
    rows = named.withColumn("at", normalize(F.col("path"))).join(
        facts.withColumnRenamed("path", "at"), ["project_id", "at"], "left"
    )
    if excluded is None:
        return rows.withColumn("excluded", F.lit(False))
    return (
        rows.withColumn("rel", F.coalesce(inside(F.col("real_path"), F.col("root")), F.concat(F.lit("\u0000"), F.col("at"))))
        .join(excluded.select("project_id", "rel", F.lit(True).alias("excluded")), ["project_id", "rel"], "left")
        .drop("rel")
    )


def check_files(named: DataFrame, facts: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``named`` (project_id, path, root, home, off, …) with ``skip`` (null = may be shared) and ``rel`` (K3)."""
    return with_limits(with_file_facts(named, facts, excluded)).select(
        *named.columns,
        skip_reason().alias("skip"),
        inside(F.col("real_path"), F.col("root")).alias("rel"),
        F.coalesce("is_file", F.lit(False)).alias("is_file"),
        "size",
        "redactions",
    )


def mentions_sender(text: Column, home: Column, words: Column) -> Column:
    """Whether a file's text holds the sender's home path, a distinctive identity word, or an e-mail."""

    def found(lower: Column) -> Column:
        parts = F.split(lower, r"[^\p{L}\p{N}]", -1)
        named = F.exists(
            F.filter(words, distinctive),
            lambda w: let(
                F.lower(w),
                lambda x: F.when(F.rlike(x, F.lit(r"[^\p{L}\p{N}]")), F.contains(lower, x)).otherwise(
                    F.array_contains(parts, x)
                ),
            ),
        )
        return F.contains(lower, F.lower(home)) | named | (mask_emails(lower)["n"] > 0)

    return let(F.lower(text), found)
