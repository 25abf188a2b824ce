"""Queries of the operators on pairs, classifiers and files; their results follow the stated contracts."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, mixture, ngram_join, paragraphs, token_files
from .common import in_fold
from .registry import query, table


@query()
def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, folder, "documents"))


@query()
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = in_fold("doc_id", 5, 0)
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_rows(table(spark, folder, "documents"))


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files written for ``docs``."""
    place = token_files.written(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read_ids(docs.sparkSession, place, zlib.crc32).withColumnRenamed("digest", "ids_crc32")


@query()
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: The tree of the mix, its weights and its seed.
LEVELS, SEED, EPOCHS = ["domain", "lang", "source"], 17, 4
WEIGHTS = {("d0",): 3, ("d1",): 2, ("d0", "en"): 4, ("d1", "en"): 3, ("d1", "es"): 2, ("d2", "de"): 2, ("d0", "en", "src0"): 5, ("d1", "en", "src0"): 5, ("d2", "en", "src0"): 5}
DOMAIN = "CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '6' THEN 'd0' WHEN substr(md5(coalesce(source, '')), 1, 1) < 'b' THEN 'd1' ELSE 'd2' END"


def mixed(docs: DataFrame) -> DataFrame:
    """The rows the mix draws, as ``row``, with domain, lang, source, epoch, passes and last_taken."""
    tree = dict(zip(LEVELS, (F.expr(DOMAIN), F.col("lang"), F.col("source"))))
    return mixture.draw(docs, mixture.plan(docs, tree, WEIGHTS, SEED, epochs=EPOCHS), tree, SEED)


def _fill(source: str, family: list[str], name: str) -> str:
    """SQL of the water filling of ``mixture.share``."""
    of = f"PARTITION BY {', '.join(family) or '1'}"
    order = f"{of} ORDER BY CAST(cap AS DOUBLE) / weight, {name}"
    path = ", ".join([*family, name])
    return f"""(SELECT {path}, CAST(CASE WHEN ok THEN cap ELSE down + CASE WHEN row_number() OVER (PARTITION BY {', '.join([*family, 'ok'])} ORDER BY rest DESC, {name}) <= spare THEN 1 ELSE 0 END END AS BIGINT) AS budget FROM (
  SELECT *, remain - sum(CASE WHEN NOT ok THEN down END) OVER ({of}) AS spare FROM (
   SELECT *, (remain * weight) // claim AS down, (remain * weight) % claim AS rest FROM (
    SELECT *, budget - coalesce(sum(CASE WHEN ok THEN cap END) OVER ({of}), 0) AS remain, sum(CASE WHEN NOT ok THEN weight END) OVER ({of}) AS claim FROM (
     SELECT *, min(one) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM (
      SELECT *, cap * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        <= (budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS one FROM {source}))))))"""


def _weights(depth: int) -> str:
    rows = [(p, w) for p, w in WEIGHTS.items() if len(p) == depth]
    tests = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(LEVELS, p)) + f" THEN {w}" for p, w in rows)
    return f"CASE {tests} ELSE 1 END" if rows else "1"


def _mix_sql() -> str:
    names = f"{DOMAIN} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source"
    steps = [
        rf"d AS (SELECT doc_id, {names}, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)",
        f"leaves AS (SELECT domain, lang, source, CAST(sum(n) AS HUGEINT) AS n_tokens, CAST(sum(n) AS HUGEINT) * {EPOCHS} AS cap FROM d GROUP BY ALL)",
    ]
    for depth in (1, 2, 3):
        path = ", ".join(LEVELS[:depth])
        budget = "(SELECT sum(n_tokens) FROM leaves)" if depth == 1 else "any_value(up.budget)"
        up = "" if depth == 1 else f" JOIN b{depth - 1} up USING ({', '.join(LEVELS[: depth - 1])})"
        steps.append(f"n{depth} AS (SELECT {path}, sum(cap) AS cap, {_weights(depth)} AS weight, CAST({budget} AS HUGEINT) AS budget FROM leaves{up} GROUP BY {path})")
        steps.append(f"b{depth} AS (SELECT * FROM {_fill(f'n{depth}', LEVELS[: depth - 1], LEVELS[depth - 1])})")
    steps.append(
        "plan AS (SELECT domain, lang, source, CASE WHEN n_tokens > 0 THEN budget // n_tokens ELSE 0 END AS passes, CASE WHEN n_tokens > 0 THEN budget % n_tokens ELSE 0 END AS rest FROM leaves JOIN b3 USING (domain, lang, source))"
    )
    steps.append(f"k AS (SELECT d.*, passes, rest, md5(concat_ws(':', '{SEED}', CAST(passes AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), '(none)'))) AS key FROM d JOIN plan USING (domain, lang, source))")
    steps.append("s AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS start FROM k)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, n AS n_tokens, "
        "CAST(CASE WHEN epoch < passes THEN n ELSE least(n, rest - start) END AS BIGINT) AS taken "
        "FROM (SELECT *, unnest(range(CAST(passes + CASE WHEN start < rest THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM s)"
    )


@query(_mix_sql())
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixed(table(spark, folder, "documents"))
    n = mixture.n_words("row.text")
    last = (F.col("epoch") == F.col("passes")) & F.col("last_taken").isNotNull()
    return rows.select(
        "row.doc_id", *LEVELS, "epoch", n.alias("n_tokens"), F.when(last, F.least(n, "last_taken")).otherwise(n).alias("taken")
    )


@query()
def op2_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    lines = paragraphs.repeats(docs).withColumn("word", F.lit(None).cast("long"))
    return lines.unionByName(paragraphs.passages(docs)).withColumn("unit", F.when(F.col("word").isNull(), "line").otherwise("passage"))
