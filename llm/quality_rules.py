"""Quality rules with DataFrame functions only: word and line counts, and lines that many documents of a host share.

The cross-document rule hashes each normalised line (A-Z lower-cased, white space as one blank, trimmed), counts the
documents of each host that have it, drops the lines of more documents than the host's limit, and rejects a
document of whose words too few are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, stored
from .url_rules import LOWER, UPPER

#: A line is dropped if more than max(LINE_DOCS, documents of its host / HOST_SHARE) documents have it, LINE_MOST at most.
LINE_DOCS, HOST_SHARE, LINE_MOST = 20, 100, 10_000
#: A document stays if at least this share of its words, in percent, is left.
LEAST_LEFT = 30
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(windows: Column) -> Column:
    """Words covered by 3-word windows found twice or more, given the windows' hashes in order."""

    def covered(pairs: Column) -> Column:
        same = lambda i, j: F.try_element_at(pairs, i)["h"] == F.try_element_at(pairs, j)["h"]
        again = F.filter(
            F.sequence(F.lit(1), F.size(pairs)), lambda i: F.coalesce((i > 1) & same(i, F.greatest(i - 1, F.lit(1))), F.lit(False)) | ((i < F.size(pairs)) & F.coalesce(same(i, i + 1), F.lit(False)))
        )
        places = F.transform(again, lambda i: F.element_at(pairs, i)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(bind(order, covered)).cast("long")


def normalised(line: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(line, f"[{SPACE}]+", " "), UPPER, LOWER))


def key(*values: Column) -> Column:
    """Two 64-bit hashes of the values, of which one has a seed of its own."""
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


def measured(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, copy (128 bits of id, host and text), the base counts, and ``lines``: 128 bits and the words of each line with a word."""
    text = F.coalesce("text", F.lit(""))
    # Split once, then use: arrays that are read several times are columns of their own.
    parts = docs.select(
        "doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"),
        F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(without(x, BLANKS)) > 0).alias("l"),
    )
    windows = F.when(F.size("w") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))
    )
    lines = F.transform("l", lambda x: F.struct(bind(normalised(x), lambda line: key(line)).alias("hash"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words")))
    counted = parts.select(
        "doc_id", "host", key(F.col("doc_id"), F.col("host"), F.col("text")).alias("copy"), F.size("w").cast("long").alias("n_words"),
        F.length(without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        windows.alias("g"), lines.alias("lines"),
    )
    return counted.withColumn("n_repeat_words", repeated_words(F.col("g"))).drop("g")


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the base counts, base_failed, n_left (words in lines that stay) and kept, a row per row of ``docs``.

    ``docs`` has doc_id, text and the host's column; other columns are not read. Null text: no words; null
    host: a host of its own. Every row is judged; rows of one doc_id and host (null ids too) count as one document in the
    limits. A text without words fails. An empty table gives no rows.
    """
    rows = stored(measured(docs, host), "measured")
    ids = rows.groupBy("host", "doc_id").agg(F.count("*").alias("rows"))
    most = F.least(F.greatest(F.lit(LINE_DOCS), F.floor(F.count("*") / HOST_SHARE)), F.lit(LINE_MOST))
    hosts = ids.groupBy("host").agg(most.alias("most"))
    each = F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash")
    # All rows with a line, less those by which its documents with several rows are counted too often.
    several = ids.where("rows > 1").select(F.col("host").alias("_host"), F.col("doc_id").alias("_id"))
    again = rows.join(several, (F.col("host") == F.col("_host")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    more = again.select("host", "doc_id", each).groupBy("host", "hash", "doc_id").agg((F.count("*") - 1).alias("n")).where("n > 0")
    counts = rows.select("host", each).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > LINE_DOCS)
    counts = counts.union(more.select("host", "hash", -F.col("n"))).groupBy("host", "hash").agg(F.sum("n").alias("n")).where(F.col("n") > LINE_DOCS)
    often = counts.join(hosts, "host").where("n > most").select("host", "hash")
    # Words of lines that go; equal rows lose the same ones.
    gone = (
        rows.select("copy", "host", F.explode("lines").alias("x")).select("copy", "host", "x.hash", "x.words").join(often, ["host", "hash"])
        .groupBy("copy").agg(F.sum("words").alias("words"))
    )
    copies = rows.groupBy("copy").agg(F.count("*").alias("rows")).where("rows > 1")
    gone = gone.join(copies, "copy", "left").select("copy", F.expr("words div coalesce(rows, 1)").alias("words"))
    out = rows.drop("lines").join(gone, "copy", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("words", F.lit(0))
    return out.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), left.alias("n_left"),
        (~failed & (100 * left >= LEAST_LEFT * F.col("n_words"))).alias("kept"),
    )
