"""Wording and shortening helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .let import first_of, let


def trimmed(s: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(s, r"(?U)^\s++|\s++\z", "")


def is_blank(s: Column) -> Column:
    return F.length(trimmed(s)) == 0


def cut(s: Column, n: int, tail: str) -> Column:
    """``s`` cut to ``n`` characters plus ``tail`` when longer."""
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit(tail))).otherwise(s)


def short_line(s: Column, n: int) -> Column:
    """All white space collapsed to single spaces, cut to ``n`` characters."""
    return let(trimmed(F.regexp_replace(s, r"(?U)\s++", " ")), lambda x: cut(x, n, "…"))


def short(s: Column, n: int) -> Column:
    """New lines become spaces, cut to ``n`` characters."""
    return cut(F.translate(s, "\n", " "), n, "…")


def trim_long(s: Column, n: int) -> Column:
    return cut(s, n, "\n… (trimmed)")


def plain(s: Column) -> Column:
    """Control and text-direction characters become ``?``."""
    return F.regexp_replace(s, "[\\p{Cc}\u202a-\u202e\u2066-\u2069]", "?")


def strip_intro(s: Column) -> Column:
    """Drop the intro an earlier conversion put in front of a conversation."""
    at = F.locate(V.INTRO_END, s, len(V.INTRO_START) + 1)
    rest = F.substr(s, at + F.lit(len(V.INTRO_END)))
    return F.when(s.startswith(V.INTRO_START) & (at > 0), F.regexp_replace(rest, r"(?U)^\s++", "")).otherwise(s)


def short_count(n: Column) -> Column:
    """850, 1.2k, 42k, 1.2M."""
    return first_of(
        (n >= 1_000_000, F.concat(_one_decimal(n / F.lit(1e6)), F.lit("M"))),
        (n >= 10_000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))),
        (n >= 1_000, F.concat(_one_decimal(n / F.lit(1e3)), F.lit("k"))),
    ).otherwise(n.cast("string"))


def _one_decimal(x: Column) -> Column:
    """One decimal, rounded on the exact binary value, ties to even."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def size_words(b: Column) -> Column:
    """B, whole KB, or MB with one decimal."""
    return first_of(
        (b >= 1 << 20, F.concat(_one_decimal(b / F.lit(float(1 << 20))), F.lit(" MB"))),
        (b >= 1 << 10, F.concat(F.floor(b / 1024).cast("string"), F.lit(" KB"))),
    ).otherwise(F.concat(b.cast("string"), F.lit(" B")))


def counted(n: Column, one: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {one}s")))


def ago(at: Column, now: Column) -> Column:
    """How long before ``now`` a time was, the way people say it."""
    s = F.greatest(F.unix_seconds(now) - F.unix_seconds(at), F.lit(0))
    div = lambda k: F.floor(s / k).cast("string")
    return first_of(
        (s < 60, F.lit("just now")),
        (s < 3600, F.concat(div(60), F.lit(" min ago"))),
        (s < 86_400, F.concat(div(3600), F.lit(" h ago"))),
        (s < 172_800, F.lit("1 day ago")),
        (s < 2_592_000, F.concat(div(86_400), F.lit(" days ago"))),
        (s < 5_184_000, F.lit("1 month ago")),
    ).otherwise(F.concat(div(2_592_000), F.lit(" months ago")))


def utc_time(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ``; the session time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def first_three(items: Column) -> Column:
    """The first three items, shortened, and ``, +N`` for the rest."""
    head = F.array_join(F.transform(F.slice(items, 1, 3), lambda i: short(i, 48)), ", ")
    more = F.when(F.size(items) > 3, F.concat(F.lit(", +"), (F.size(items) - 3).cast("string"))).otherwise("")
    return F.concat(head, more)


def brief_reason(why: Column) -> Column:
    """A withholding reason in two or three words."""
    has = lambda part: F.contains(why, F.lit(part))
    return first_of(
        (has("personal folder"), F.lit("personal")),
        (has("sensitive"), F.lit("secrets")),
        (has("outside the project"), F.lit("outside the project")),
        (has("gitignored"), F.lit("gitignored")),
        (has("unchecked"), F.lit("can't check")),
        (has("connected tool"), F.lit("connected tool")),
        (has("unticked") | has("excluded"), F.lit("you unticked it")),
        (has("over 10 MB"), F.lit("over 10 MB")),
        (has("over 1 GB"), F.lit("over 1 GB")),
    ).otherwise(why)


def withheld_note(why: Column) -> Column:
    head = f"[withheld by {V.TOOL} when sharing; the agent saw the real content at the time: "
    return F.concat(F.lit(head), why, F.lit("]"))


def without_cd(cmd: Column) -> Column:
    return trimmed(F.regexp_replace(cmd, "(?U)" + V.CD_PREFIX, ""))


def session_id_of(file_name: Column) -> Column:
    """The id at the end of a log's file name (without extension)."""
    tail = F.right(file_name, F.lit(36))
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
    return F.when(tail.rlike(uuid), tail).otherwise(file_name)


def stable_uuid(*parts: Column) -> Column:
    """A repeatable id in UUID form from a hash of ``parts``."""
    h = F.sha2(F.concat_ws("\u241f", *[p.cast("string") for p in parts]), 256)
    cut_at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut_at])
