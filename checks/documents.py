"""Secret and e-mail rules over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logferry.functions import secrets as S
from logferry.functions import values as V
from logferry.plans.corpus import findings, findings_by_rule, redact_corpus

from . import sqltext as X
from .lifts import PIECE, PLANTED
from .registry import Tables, query


def planted(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", F.expr(f"text || chr(10) || {PIECE}").alias("text"), "lang", "source"
    )


CHAIN = f"WITH src AS (SELECT * FROM documents),\n{X.rule_steps('src')}"
PLANTED_CHAIN = f"WITH src AS ({PLANTED}),\n{X.rule_steps('src')}"


@query(
    f"{CHAIN},\n{X.email_steps(X.LAST, keep=', len(found) AS n_secrets')}\n"
    "SELECT doc_id, masked AS clean, CAST(n_secrets AS BIGINT) AS n_secrets, CAST(n AS BIGINT) AS n_emails FROM e1"
)
def redact_documents(t: Tables) -> DataFrame:
    return redact_corpus(t.documents.select("doc_id", "text"), "text").select("doc_id", "clean", "n_secrets", "n_emails")


@query(
    f"{PLANTED_CHAIN},\n{X.email_steps(X.LAST, keep=', len(found) AS n_secrets')}\n"
    "SELECT doc_id, masked AS clean, CAST(n_secrets AS BIGINT) AS n_secrets, CAST(n AS BIGINT) AS n_emails FROM e1"
)
def redact_planted(t: Tables) -> DataFrame:
    return redact_corpus(planted(t), "text").select("doc_id", "clean", "n_secrets", "n_emails")


@query(
    f"{PLANTED_CHAIN}, f AS (SELECT doc_id, unnest(found) AS f FROM {X.LAST})\n"
    "SELECT f.rule AS rule, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM f GROUP BY 1"
)
def secret_findings_by_rule(t: Tables) -> DataFrame:
    return findings_by_rule(planted(t), "text")


@query(
    f"{PLANTED_CHAIN}, f AS (SELECT doc_id, unnest(found) AS f FROM {X.LAST})\n"
    "SELECT doc_id, f.rule AS rule, f.value AS value FROM f"
)
def redacted_values(t: Tables) -> DataFrame:
    return findings(planted(t), "text", "doc_id")


@query(
    f"WITH src AS ({PLANTED}),\n{X.callback_hits('src')}\n"
    f"SELECT doc_id, {X.first_rule('text', False)} AS rule, {X.first_rule('text', True)} AS key_rule FROM hits"
)
def first_secret_rule(t: Tables) -> DataFrame:
    text = F.col("text")
    possible = S.any_rule_possible(text)
    return planted(t).select(
        "doc_id",
        F.when(possible, S.first_rule(text)).alias("rule"),
        F.when(possible, S.first_rule(text, strong_only=True)).alias("key_rule"),
    )


@query(f"WITH src AS ({PLANTED}) SELECT DISTINCT source, value FROM (SELECT source, unnest({X.learned('text')}) AS value FROM src)")
def learned_values(t: Tables) -> DataFrame:
    return planted(t).select("source", F.explode(S.secret_values(F.col("text"))).alias("value")).distinct()


@query(
    f"WITH src AS (SELECT conv_id, turn, text FROM conversations), {X.email_steps('src', 'conv_id', 'text', ', turn')} "
    "SELECT conv_id, turn, masked AS text, CAST(n AS BIGINT) AS n_emails FROM e1"
)
def email_mask_conversations(t: Tables) -> DataFrame:
    m = t.conversations.select("conv_id", "turn", S.mask_emails(F.col("text")).alias("m"))
    return m.select("conv_id", "turn", F.col("m.text").alias("text"), F.col("m.n").alias("n_emails"))


@query(
    f"{PLANTED_CHAIN},\n{X.email_steps(X.LAST, keep=', len(found) AS n_secrets')}\n"
    "SELECT source, lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n_secrets) AS BIGINT) AS secrets, "
    "CAST(sum(n) AS BIGINT) AS emails, CAST(count(*) FILTER (n_secrets + n > 0) AS BIGINT) AS touched "
    "FROM e1 JOIN src USING (doc_id) GROUP BY 1, 2"
)
def redact_rate_by_source(t: Tables) -> DataFrame:
    return (
        redact_corpus(planted(t), "text")
        .groupBy("source", "lang")
        .agg(
            F.count("*").alias("docs"),
            F.sum("n_secrets").alias("secrets"),
            F.sum("n_emails").alias("emails"),
            F.count_if(F.col("n_secrets") + F.col("n_emails") > 0).alias("touched"),
        )
    )


@query(
    f"{PLANTED_CHAIN}\nSELECT quality, toxic, CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(found)) AS BIGINT) AS secrets "
    f"FROM {X.LAST} LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"
)
def redacted_vs_quality(t: Tables) -> DataFrame:
    found = redact_corpus(planted(t), "text").select("doc_id", "n_secrets")
    return (
        found.join(t.labels, "doc_id", "left")
        .groupBy("quality", "toxic")
        .agg(F.count("*").alias("docs"), F.sum("n_secrets").alias("secrets"))
    )


# Names and values drawn from part names and customer comments' shapes: NAME_WORD, nameWord, name.word …
NAME_WORDS = [*V.SECRET_WORDS, *V.KEY_PREFIXES, "key", "port", "bypass", "tokenizer", "tokens", "passport"]
_WORD = lambda n: "[" + ", ".join(X.quote(w) for w in NAME_WORDS) + f"][1 + CAST((p_partkey * {n}) % {len(NAME_WORDS)} AS INT)]"
_SPARK_WORD = lambda n: (
    "element_at(array(" + ", ".join(X.quote(w) for w in NAME_WORDS) + f"), 1 + CAST((p_partkey * {n}) % {len(NAME_WORDS)} AS INT))"
)


def _key_name(word) -> str:
    a, b = word(1), word(7)
    big = lambda w: f"upper(substr({w}, 1, 1)) || substr({w}, 2)"
    return (
        f"CASE p_partkey % 5 WHEN 0 THEN upper({a}) || '_' || upper({b}) WHEN 1 THEN {a} || {big(b)} "
        f"WHEN 2 THEN {a} || '.' || {b} WHEN 3 THEN {a} || {b} ELSE 'max_' || {a} END"
    )


_VALUES = [
    "your-password-here", "your-Pr0dPass", "changeme", "changeme_Xk29", "xxxx", "****", "<token>", "${API_KEY}", "{{ secret }}",
    "^0.6.0", "1.2.3-rc1", "process.env.X", "env[0]", "abc", " test ", "hunter22", "string", "Boolean", "required", "%s", "...",
    "your password", "$token", "Password", "v1.2",
]
def _literal(v: str) -> str:
    """A quoted value whose $ is not taken for a variable."""
    return X.quote(v).replace("${", "$' || '{")


_VALUE_SQL = "[" + ", ".join(_literal(v) for v in _VALUES) + f"][1 + CAST(p_partkey % {len(_VALUES)} AS INT)]"
_VALUE_SPARK = "element_at(array(" + ", ".join(_literal(v) for v in _VALUES) + f"), 1 + CAST(p_partkey % {len(_VALUES)} AS INT))"


@query(
    f"WITH src AS (SELECT p_partkey, {_key_name(_WORD)} AS name, {_VALUE_SQL} AS value FROM part) "
    f"SELECT p_partkey, name, value, {X.secret_key('name')} AS secret_name, {X.placeholder('value', 'name')} AS placeholder, "
    f"{X.type_word('value')} AS type_word FROM src"
)
def secret_names_and_placeholders(t: Tables) -> DataFrame:
    src = t.part.select("p_partkey", F.expr(_key_name(_SPARK_WORD)).alias("name"), F.expr(_VALUE_SPARK).alias("value"))
    name, value = F.col("name"), F.col("value")
    return src.select(
        "p_partkey",
        "name",
        "value",
        S.secret_key(name).alias("secret_name"),
        S.placeholder(value, name).alias("placeholder"),
        S.type_word(value).alias("type_word"),
    )
