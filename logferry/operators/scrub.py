"""Scrubbing text and whole records: secrets, e-mails, paths, identity, echoes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import values as V
from ..functions.jsontext import KEY_OR_STRING, decode, encode, is_key, json_string, structure
from ..functions.let import let
from ..functions.paths import distinctive, filter_on, url_path
from ..functions.secrets import any_rule_possible, mask_emails, redact_if_needed
from ..session import cut_lineage

KEYS = ["project_id", "session_id"]
WORD = "struct<gate:string,pattern:string,put:string>"
LINE = [*KEYS, "line_no"]
# Columns a scrubbing context adds to a row.
CONTEXT = ["root", "home", "off", "words", "echoes", "places"]
# Learned values a row may carry as an array; sessions with more go through a join, with the same result.
ECHO_ARRAY_LIMIT = 500
REPEATED = "[REDACTED:repeated]"
# No learned value is shorter than this many characters.
WINDOW = 8


@dataclass
class Context:
    """What scrubbing needs: one row per session, and the learned values of sessions with very many."""

    rows: DataFrame
    many: DataFrame | None = None


def _pattern_text(word: Column) -> Column:
    """A word as a pattern that matches it literally."""
    return F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def identity_patterns(words: Column) -> Column:
    """``array<struct<gate, pattern, put>>`` from (word, replacement) pairs: a distinctive word is replaced
    wherever letters do not touch it, a common one only in home folders and file listings."""

    def patterns(w: Column) -> Column:
        lit = _pattern_text(w["word"])
        put = F.concat(F.lit("$1"), F.regexp_replace(w["replacement"], r"([\\$])", r"\\$1"), F.lit("$2"))
        one = lambda head, tail: F.struct(
            F.lower(w["word"]).alias("gate"), F.concat(F.lit(head), lit, F.lit(tail)).alias("pattern"), put.alias("put")
        )
        anywhere = one(r"(?iu)(^|[^a-z]|%2f)", r"([^a-z]|\z)")
        folders = one(
            r"(?iu)(/Users/|/home/|\\Users\\|-Users-|-home-|%2FUsers%2F|%2Fhome%2F)", r"([^a-z0-9]|\z)"
        )
        listing = one(r"(?U)((?:^|\s)[-dlcbps][-rwxsStT]{9}[@+.]?\s+\d+\s+)", r"(\s)")
        return F.when(distinctive(w["word"]), F.array(anywhere)).otherwise(F.array(folders, listing))

    return F.flatten(F.transform(words, patterns))


def place_spellings(root: Column, home: Column, off: Column) -> Column:
    """``array<struct<find, put>>``: the spellings of the project and home folder to replace, in order,
    worked out once per session."""
    forward = lambda p: F.replace(p, F.lit("\\"), F.lit("/"))
    one = lambda find, put, when: F.when(when, F.struct(find.alias("find"), F.lit(put).alias("put")))
    by_name = filter_on(off, "identity")
    spellings = F.array(
        one(root, V.ROOT, F.lit(True)),
        one(forward(root), V.ROOT, forward(root) != root),
        one(url_path(root), V.ROOT_URL, url_path(root) != root),
        one(home, "~", by_name),
        one(forward(home), "~", by_name & (forward(home) != home)),
    )
    return F.filter(spellings, lambda p: p.isNotNull())


def scrub_context(sessions: DataFrame, identity: DataFrame | None, echoes: DataFrame | None) -> Context:
    """Per session: root, home, off, identity patterns in order, and learned values longest first (O3).

    ``identity`` is project_id, word, replacement, position; ``echoes`` is session keys and value.
    """
    ctx = sessions.select(*KEYS, "root", "home", "off")
    if identity is not None:
        people = identity.groupBy("project_id").agg(
            F.array_sort(F.collect_list(F.struct("position", "word", "replacement"))).alias("people")
        )
        patterns = F.when(filter_on(F.col("off"), "identity"), identity_patterns(F.col("people")))
        ctx = ctx.join(people, "project_id", "left").withColumn("words", patterns).drop("people")
    else:
        ctx = ctx.withColumn("words", F.lit(None).cast(f"array<{WORD}>"))
    ctx = ctx.withColumn("places", place_spellings(F.col("root"), F.col("home"), F.col("off")))
    many = None
    if echoes is not None:
        crowded = echoes.groupBy(*KEYS).agg(F.count("*").alias("_n")).where(F.col("_n") > ECHO_ARRAY_LIMIT).select(*KEYS)
        few = echoes
        if not crowded.isEmpty():
            scanned = sessions.where(filter_on(F.col("off"), "secret-scan")).select(*KEYS)
            many = echoes.join(crowded, KEYS, "left_semi").join(scanned, KEYS, "left_semi").select(*KEYS, "value").distinct()
            few = echoes.join(crowded, KEYS, "left_anti")
        learned = few.groupBy(*KEYS).agg(_longest_first("value").alias("learned"))
        ctx = ctx.join(learned, KEYS, "left").withColumn(
            "echoes", F.when(filter_on(F.col("off"), "secret-scan"), F.col("learned"))
        ).drop("learned")
    else:
        ctx = ctx.withColumn("echoes", F.lit(None).cast("array<string>"))
    ctx = ctx.withColumn("words", F.coalesce("words", F.array().cast(f"array<{WORD}>"))).withColumn(
        "echoes", F.coalesce("echoes", F.array().cast("array<string>"))
    )
    return Context(ctx, many)


def _longest_first(value: str) -> Column:
    """Distinct values, longest in bytes first, ties in value order: a value that holds another goes whole."""
    ranked = F.array_sort(F.collect_set(F.struct((-F.octet_length(value)).alias("n"), F.col(value).alias("value"))))
    return F.transform(ranked, lambda e: e["value"])


def _occurrences(text: Column, part: Column) -> Column:
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.floor(gone / F.length(part)).cast("bigint")


def _state(text: Column, secrets: Column, emails: Column) -> Column:
    return F.struct(
        text.alias("text"), secrets.cast("bigint").alias("secrets"), emails.cast("bigint").alias("emails")
    )


def without_echoes(state: Column) -> Column:
    """``state`` (text, secrets, emails) with the row's learned values replaced, in their order."""
    fold = F.aggregate(
        F.col("echoes"),
        state,
        lambda x, e: F.when(
            F.contains(x["text"], e),
            _state(
                F.replace(x["text"], e, F.lit(REPEATED)),
                x["secrets"] + _occurrences(x["text"], e),
                x["emails"],
            ),
        ).otherwise(x),
    )
    return F.when(F.exists(F.col("echoes"), lambda e: F.contains(state["text"], e)), fold).otherwise(state)


def _fold(text: Column, steps: Column, put: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(steps, text, put)


def places(text: Column) -> Column:
    """The spellings of the project and home folder replaced."""
    return _fold(text, F.col("places"), lambda x, p: F.replace(x, p["find"], p["put"]))


def _named(text: Column) -> Column:
    """Whether a text may hold one of the identity words of the row."""
    return F.exists(F.col("words"), lambda w: F.contains(F.lower(text), w["gate"]))


def _echoed(text: Column) -> Column:
    return F.exists(F.col("echoes"), lambda e: F.contains(text, e))


def people(text: Column) -> Column:
    """The identity words replaced. Twice: neighbouring matches share the separator between them."""
    swap = lambda x, w: F.regexp_replace(F.regexp_replace(x, w["pattern"], w["put"]), w["pattern"], w["put"])
    return _fold(text, F.col("words"), lambda x, w: F.when(F.contains(F.lower(x), w["gate"]), swap(x, w)).otherwise(x))


def _speaks(text: Column) -> Column:
    """Whether a text may hold a secret or an address at all."""
    return F.contains(text, F.lit("@")) | F.contains(text, F.lit("%40")) | any_rule_possible(text)


def scrub_text(text: Column, possible: Column | None = None) -> Column:
    """``struct<text, secrets, emails>`` of one text; the row carries the columns of ``CONTEXT``.

    ``possible`` false says that no text of the record can hold a secret or an address.
    """
    off, zero = F.col("off"), F.lit(0).cast("bigint")
    state = _state

    def secrets(t: Column) -> Column:
        found = let(redact_if_needed(t), lambda r: state(r["text"], F.size(r["found"]), zero))
        return F.when(filter_on(off, "secret-scan"), found).otherwise(state(t, zero, zero))

    def emails(s: Column) -> Column:
        masked = let(mask_emails(s["text"]), lambda m: state(m["text"], s["secrets"], m["n"]))
        return F.when(filter_on(off, "emails"), masked).otherwise(s)

    clean = let(secrets(text), emails)
    placed = let(clean, lambda s: state(people(places(s["text"])), s["secrets"], s["emails"]))
    quiet = let(people(places(text)), lambda t: F.when(_echoed(t), without_echoes(state(t, zero, zero))).otherwise(state(t, zero, zero)))
    speaks = _speaks(text) if possible is None else possible & _speaks(text)
    return F.when(speaks, let(placed, without_echoes)).otherwise(quiet)


def _tokens(record: Column) -> Column:
    return F.regexp_extract_all(record, F.lit(KEY_OR_STRING), F.lit(0))


def _texts(tokens: Column) -> Column:
    return decode(F.transform(tokens, lambda t: F.regexp_replace(t, r"\s*:\z", "")))


def _rewritten(record: Column, scrub: Callable[[Column], Column]) -> Column:
    """``struct<json, secrets, emails>``: every string and object key of a JSON record through ``scrub``;
    ``data:`` strings and base64 payloads stay."""
    tokens, zero = _tokens(record), F.lit(0)
    opaque = F.when(F.contains(record, F.lit('"base64"')), structure(record)["opaque"]).otherwise(
        F.array().cast("array<int>")
    )
    texts = F.arrays_zip(_texts(tokens).alias("text"), F.transform(tokens, is_key).alias("key"))
    done = let(
        opaque,
        lambda hidden: F.transform(
            texts,
            lambda x, i: F.when(
                ~x["key"] & (F.startswith(x["text"], F.lit("data:")) | F.array_contains(hidden, i)),
                _state(x["text"], zero, zero),
            ).otherwise(scrub(x["text"])),
        ),
    )

    def rebuilt(ds: Column) -> Column:
        fresh = encode(F.transform(ds, lambda d: d["text"]))
        tails = F.transform(tokens, lambda t: F.when(is_key(t), F.lit(":")).otherwise(""))
        with_tails = F.zip_with(fresh, tails, lambda a, b: F.concat(a, b))
        total = lambda name: F.aggregate(ds, F.lit(0).cast("bigint"), lambda acc, d: acc + d[name])
        return F.struct(
            F.array_join(
                F.zip_with(
                    F.split(record, KEY_OR_STRING, -1),
                    F.concat(with_tails, F.array(F.lit(""))),
                    lambda a, b: F.concat(a, b),
                ),
                "",
            ).alias("json"),
            total("secrets").alias("secrets"),
            total("emails").alias("emails"),
        )

    return let(done, rebuilt)


# A record whose strings stand in it as they are: no escapes or control characters, no slash outside strings, no
# space between a key and its colon.
AS_IT_IS = r'\A(?:[^"/\\\x00-\x1f]*+"[^"\\\x00-\x1f]*+"(?!\s+:))*+[^"/\\\x00-\x1f]*+\z'
# A string that is not written as it reads.
SPELLED = r"\\|\s:\z|[\x00-\x1f]"


def _record_speaks(record: Column) -> Column:
    """Whether a string of a record may hold a secret or an address.

    The tests look at neighbouring letters, digits and ``-_.:/%@`` only. Strings without ``\\u`` and ``\\/`` show
    these in the record as they are, so what is possible in a string is possible in the record.
    """
    return _speaks(record) | F.contains(record, F.lit("\\u")) | F.contains(record, F.lit("\\/"))


def _inside_strings() -> Column:
    """Whether the folders to replace cannot reach over the end of a string or stand outside one."""
    outside = lambda p: F.contains(p["find"], F.lit('"')) | ~F.rlike(p["find"], F.lit(r"[/\\]"))
    return ~F.exists(F.col("places"), outside)


def _one_by_one(record: Column, speaks: Column) -> Column:
    """``_rewritten`` by ``scrub_text``, but only strings in which something may be replaced are decoded and written
    anew. The large expression stands here once."""
    zero = F.lit(0).cast("bigint")
    out = lambda text, n, m: F.struct(text.alias("json"), n.alias("secrets"), m.alias("emails"))
    opaque = F.when(F.contains(record, F.lit('"base64"')), structure(record)["opaque"]).otherwise(
        F.array().cast("array<int>")
    )
    sound = F.is_valid_utf8(record) & _inside_strings()

    def done(sound: Column, hidden: Column, token: Column, i: Column) -> Column:
        key = is_key(token)
        stays = lambda text: ~key & (F.startswith(text, F.lit("data:")) | F.array_contains(hidden, i))
        anew = lambda d: out(F.concat(json_string(d["text"]), F.when(key, F.lit(":")).otherwise("")), d["secrets"], d["emails"])
        apart = let(
            F.get(_texts(F.array(token)), F.lit(0)),
            lambda t: let(F.when(stays(t), _state(t, zero, zero)).otherwise(scrub_text(t, speaks)), anew),
        )
        at_once = let(places(token), lambda t: F.when(~_named(t) & ~_echoed(t), out(t, zero, zero)))
        plain = sound & ~F.rlike(token, F.lit(SPELLED)) & ~(speaks & _speaks(token))
        hides = F.startswith(token, F.lit('"data:')) | F.array_contains(hidden, i)
        return F.coalesce(F.when(plain & ~hides, at_once), apart)

    def rebuilt(ds: Column) -> Column:
        total = lambda name: F.aggregate(ds, F.lit(0).cast("bigint"), lambda acc, d: acc + d[name])
        between = F.split(record, KEY_OR_STRING, -1)
        fresh = F.concat(F.transform(ds, lambda d: d["json"]), F.array(F.lit("")))
        return out(F.array_join(F.zip_with(between, fresh, lambda a, b: F.concat(a, b)), ""), total("secrets"), total("emails"))

    # A string that cannot be read leaves nothing of the record but what follows the last one.
    unread = out(F.element_at(F.split(record, KEY_OR_STRING, -1), -1), zero, zero)
    read = let(
        F.struct(sound.alias("sound"), opaque.alias("hidden")),
        lambda x: F.transform(_tokens(record), lambda t, i: done(x["sound"], x["hidden"], t, i)),
    )
    return F.when(F.size(_texts(_tokens(record))) == F.size(_tokens(record)), let(read, rebuilt)).otherwise(unread)


@lru_cache(maxsize=8)
def scrubbed_record(json: str) -> Column:
    """The JSON record in column ``json`` scrubbed; the large expression is built once per process.

    Where nothing but folders can be replaced in any of its strings, and only in strings, that is done in the whole record.
    """
    record, zero = F.col(json), F.lit(0).cast("bigint")

    def scrubbed(speaks: Column) -> Column:
        done = lambda r: F.struct(r.alias("json"), zero.alias("secrets"), zero.alias("emails"))
        at_once = let(places(record), lambda r: F.when(~_named(r) & ~_echoed(r), done(r)))
        opaque = F.contains(record, F.lit('"data:')) | F.contains(record, F.lit('"base64"'))
        whole = ~speaks & ~opaque & F.rlike(record, F.lit(AS_IT_IS)) & F.is_valid_utf8(record) & _inside_strings()
        return F.coalesce(F.when(whole, at_once), _one_by_one(record, speaks))

    return let(_record_speaks(record), scrubbed)


def _touches_marker(value: Column) -> Column:
    """Whether a value can occur across or inside the marker that replaces another value."""
    n = len(REPEATED)
    ends = "|".join(re.escape(REPEATED[:i]) + r"\z" for i in range(1, n))
    starts = "|".join(r"\A" + re.escape(REPEATED[i:]) for i in range(1, n))
    return F.contains(value, F.lit(REPEATED)) | F.contains(F.lit(REPEATED), value) | F.rlike(value, F.lit(f"{ends}|{starts}"))


def without_many_echoes(lines: DataFrame, many: DataFrame) -> DataFrame:
    """Scrubbed lines (keys, line_no, raw, secrets) with the learned values of crowded sessions replaced.

    A value can only occur where its first eight characters do: the windows of a line's strings meet
    the values' heads in an equi-join, so a line only carries values that may be in it. The windows of
    one session spread over all tasks. Once a value of a line is replaced, values that touch the marker
    may occur too, so such a line carries those of its session as well: the result is that of going through
    all values, longest first.
    """
    lines = cut_lineage(lines)
    crowded = many.select(*KEYS).distinct()
    windows = F.array_distinct(
        F.flatten(
            F.transform(
                _texts(_tokens(F.col("raw"))),
                lambda t: F.when(
                    F.length(t) >= WINDOW,
                    F.transform(F.sequence(F.lit(1), F.length(t) - (WINDOW - 1)), lambda i: F.substr(t, i, F.lit(WINDOW))),
                ).otherwise(F.array().cast("array<string>")),
            )
        )
    )
    heads = many.select(*KEYS, F.left("value", F.lit(WINDOW)).alias("_window"), "value")
    hits = cut_lineage(
        lines.where(F.col("raw").isNotNull())
        .join(crowded, KEYS, "left_semi")
        .select(*LINE, F.explode(windows).alias("_window"))
        .join(heads, [*KEYS, "_window"])
        .select(*LINE, "value")
        .distinct()
    )
    later = hits.select(*LINE).distinct().join(many.where(_touches_marker(F.col("value"))), KEYS).select(*LINE, "value")
    per_line = hits.union(later).groupBy(*LINE).agg(_longest_first("value").alias("echoes"))
    zero = F.lit(0)
    rows = lines.join(per_line, LINE, "left").withColumn(
        "_e",
        F.when(
            F.col("echoes").isNotNull() & F.col("raw").isNotNull(),
            _rewritten(F.col("raw"), lambda t: without_echoes(_state(t, zero, zero))),
        ),
    )
    return rows.select(
        *[c for c in lines.columns if c not in ("raw", "secrets")],
        F.coalesce("_e.json", "raw").alias("raw"),
        (F.col("secrets") + F.coalesce("_e.secrets", zero)).alias("secrets"),
    ).select(*lines.columns)


@lru_cache(maxsize=8)
def scrubbed_text(text: str) -> Column:
    """``scrub_text`` of a column by name, built once per process."""
    return scrub_text(F.col(text))


def leaks(clean_lines: DataFrame, echoes: DataFrame) -> DataFrame:
    """``keys, line_no, value`` of learned values still in a string of a cleaned line: must be empty.

    Values are looked for in the decoded strings and keys, so escapes hide none.
    """
    clean_lines = clean_lines.withColumn("raw", F.array_join(_texts(_tokens(F.col("raw"))), "\n"))
    windows = F.explode(
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length("raw") - (WINDOW - 1), F.lit(1))),
                lambda i: F.substr(F.col("raw"), i, F.lit(WINDOW)),
            )
        )
    )
    heads = echoes.select(*KEYS, F.left("value", F.lit(WINDOW)).alias("_window"), "value")
    return (
        clean_lines.select(*LINE, "raw", windows.alias("_window"))
        .join(heads, [*KEYS, "_window"])
        .where(F.contains("raw", F.col("value")))
        .select(*LINE, "value")
        .distinct()
    )
