"""Redaction and findings over any text table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.secrets import mask_emails, redacted


def redact_corpus(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``clean``, ``n_secrets``, ``n_emails`` and ``findings`` for its text column; no shuffle."""
    return (
        df.withColumn("_r", redacted(text))
        .withColumn("_m", mask_emails(F.col("_r.text")))
        .select(
            *df.columns,
            F.col("_m.text").alias("clean"),
            F.size("_r.found").cast("bigint").alias("n_secrets"),
            F.col("_m.n").alias("n_emails"),
            F.col("_r.found").alias("findings"),
        )
    )


def findings(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per replaced secret: ``key, rule, value``."""
    return df.select(key, F.explode(redacted(text)["found"]).alias("f")).select(key, "f.rule", "f.value")


def findings_by_rule(df: DataFrame, text: str) -> DataFrame:
    """Per rule: replacements, and texts with at least one.

    A text's findings are counted inside its row, so the one shuffle carries a partial sum per
    rule and task, whatever rule fires most.
    """
    return _rule_counts(df.select(redacted(text)["found"].alias("found"))).groupBy("rule").agg(
        F.sum("n").cast("bigint").alias("n"), F.count("*").cast("bigint").alias("n_docs")
    )


def _rule_counts(found: DataFrame) -> DataFrame:
    """One row per text and rule with how often it fired, from a column ``found``."""
    rules = F.transform("found", lambda f: f["rule"])
    per_rule = F.transform(
        F.array_distinct(rules),
        lambda r: F.struct(r.alias("rule"), F.size(F.filter("found", lambda f: f["rule"] == r)).alias("n")),
    )
    others = [c for c in found.columns if c != "found"]
    return found.select(*others, F.explode(per_rule).alias("c")).select(*others, "c.rule", "c.n")
