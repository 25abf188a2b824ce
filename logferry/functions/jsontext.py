"""JSON records as text segments and VARIANT: reading, blanking and rewriting strings without leaving the JVM.

A JSON text is an alternation of string tokens and what stands between them, so
``split`` and ``regexp_extract_all`` on one token pattern take it apart exactly and
``zip_with`` puts it back together (H24-H26). Key order, number spelling and spacing of
what is not rewritten stay as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .let import any_of, empty_strings, first_of, let

STRING = r'"(?:[^"\\]++|\\.)*+"'
KEY_OR_STRING = STRING + r"(?:\s*+:)?+"
EVENT = KEY_OR_STRING + r"|[{}\[\]]"


# --- VARIANT access -----------------------------------------------------------------


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str) -> Column:
    """The string at ``path``; null when it is missing or not a string."""
    return let(
        field(v, path), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    )


def true_at(v: Column, path: str) -> Column:
    """Whether the value at ``path`` is JSON ``true``."""
    return F.coalesce(F.to_json(field(v, path)) == "true", F.lit(False))


def items_at(v: Column, path: str) -> Column:
    """The array at ``path`` as ``array<variant>``; null when it is not an array."""
    return F.try_variant_get(v, path, "array<variant>")


def members_at(v: Column, path: str) -> Column:
    """The object at ``path`` as ``map<string, variant>``; null when it is not an object."""
    return F.try_variant_get(v, path, "map<string,variant>")


# --- editing objects ------------------------------------------------------------------


def without_keys(v: Column, path: str, keys: list[str]) -> Column:
    """JSON text of the object at ``path`` without some members."""
    return F.to_json(F.map_filter(members_at(v, path), lambda k, _: ~k.isin(*keys)))


def set_members(members: Column, changes: dict[str, Column]) -> Column:
    """``map<string,variant>`` with the JSON text given for some keys put in, where the key is
    present and the text is not null. Each text is worked out once."""
    put = lambda json, x: let(json, lambda j: F.when(j.isNotNull(), F.try_parse_json(j)).otherwise(x))
    return F.transform_values(
        members,
        lambda k, x: first_of(*[(k == name, put(json, x)) for name, json in changes.items()]).otherwise(x),
    )


def names_key(raw: Column, objects: list[Column], names: list[str]) -> Column:
    """Whether one of the objects of a record has one of the keys, however the key is spelled.

    Plain spellings show in the text; letters of a key can also be spelled as ``\\u`` escapes, so a text
    that holds any is decided by its parsed keys.
    """
    plain = F.rlike(raw, F.lit('"(?:' + "|".join(names) + ')"'))
    parsed = [F.coalesce(F.exists(F.map_keys(o), lambda k: k.isin(*names)), F.lit(False)) for o in objects]
    return plain | (F.contains(raw, F.lit("\\u")) & any_of(*parsed))


# --- string tokens --------------------------------------------------------------------


def is_key(token: Column) -> Column:
    return F.endswith(token, F.lit(":"))


def decode(tokens: Column) -> Column:
    """Texts of JSON string tokens."""
    joined = F.concat(F.lit("["), F.array_join(tokens, ","), F.lit("]"))
    return F.coalesce(F.from_json(joined, "array<string>"), empty_strings())


def encode(texts: Column) -> Column:
    """JSON string tokens of texts."""
    return F.regexp_extract_all(F.to_json(texts), F.lit(STRING), F.lit(0))


def json_string(text: Column) -> Column:
    return F.get(encode(F.array(text)), F.lit(0))


def strings(json: Column) -> Column:
    """All string values of a JSON text in text order; key-sorted when it comes from a VARIANT."""
    tokens = F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(KEY_OR_STRING), F.lit(0))
    return decode(F.filter(tokens, lambda t: ~is_key(t)))


def rewrite_tokens(json: Column, rewritten: Callable[[Column], Column]) -> Column:
    """``json`` with its key and string tokens replaced by ``rewritten(tokens)``."""
    return let(
        F.regexp_extract_all(json, F.lit(KEY_OR_STRING), F.lit(0)),
        lambda tokens: F.array_join(
            F.zip_with(
                F.split(json, KEY_OR_STRING, -1),
                F.concat(rewritten(tokens), F.array(F.lit(""))),
                lambda a, b: F.concat(a, b),
            ),
            "",
        ),
    )


def blank_strings(json: Column, note: Column) -> Column:
    """Every string value replaced by ``note``; keys, numbers and structure stay."""
    return let(
        json_string(note),
        lambda n: rewrite_tokens(json, lambda ts: F.transform(ts, lambda t: F.when(is_key(t), t).otherwise(n))),
    )


def replace_in_strings(json: Column, find: Column, put: Column) -> Column:
    """``find`` replaced by ``put`` in every string value, however the string is spelled (H24). Keys are left alone.

    A string that holds ``find`` is decoded, changed and written anew; all others keep their spelling.
    """
    quoted = let(json_string(find), lambda q: F.substr(q, F.lit(2), F.length(q) - 2))

    def rewritten(tokens: Column) -> Column:
        texts = decode(F.transform(tokens, lambda t: F.when(is_key(t), F.lit('""')).otherwise(t)))
        return let(
            texts,
            lambda xs: F.zip_with(
                tokens,
                xs,
                lambda t, x: F.when(is_key(t) | ~F.coalesce(F.contains(x, find), F.lit(False)), t).otherwise(
                    json_string(F.replace(x, find, put))
                ),
            ),
        )

    possible = F.contains(json, quoted) | F.contains(json, F.lit("\\"))
    return F.when(possible, rewrite_tokens(json, rewritten)).otherwise(json)


# --- one pass over the structure --------------------------------------------------------

_FRAME = "bytes:bigint,images:bigint,base64:boolean,skipped:boolean,data:int"
_STATE = f"struct<stack:array<struct<{_FRAME}>>,key:string,at:int,opaque:array<int>>"


def _frame(bytes_=0, images=0, base64=False, skipped=False, data=-1) -> Column:
    as_col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        as_col(bytes_, "bigint").alias("bytes"),
        as_col(images, "bigint").alias("images"),
        as_col(base64, "boolean").alias("base64"),
        as_col(skipped, "boolean").alias("skipped"),
        as_col(data, "int").alias("data"),
    )


def structure(json: Column) -> Column:
    """``struct<bytes, images, opaque>`` of a JSON text in one fold over its tokens and brackets.

    ``bytes`` is what a model reads: the UTF-8 length of all strings but those under a key
    named ``type``, image data and base64 objects, which ``images`` counts instead.
    ``opaque`` lists the positions (among key and string tokens) of base64 payloads.
    The fold keeps a stack of open objects and arrays, so its work is linear in the text.
    """
    events = F.regexp_extract_all(json, F.lit(EVENT), F.lit(0))
    all_texts = decode(
        F.transform(F.regexp_extract_all(json, F.lit(KEY_OR_STRING), F.lit(0)), lambda t: F.regexp_replace(t, r"\s*:\z", ""))
    )

    def state(stack, key, at, opaque):
        return F.struct(
            stack.alias("stack"), key.cast("string").alias("key"), at.cast("int").alias("at"), opaque.alias("opaque")
        )

    def step(texts, s, e):
        top = F.element_at(s["stack"], -1)
        rest = F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)
        none = F.lit(None)
        skip_here = (s["key"] == "type").eqNullSafe(F.lit(True)) | top["skipped"]

        def closed():
            below = F.element_at(rest, -1)
            beneath = F.slice(rest, F.lit(1), F.size(rest) - 1)
            merged = first_of(
                (top["skipped"], below),
                (top["base64"], _frame(below["bytes"], below["images"] + 1, below["base64"], below["skipped"], below["data"])),
            ).otherwise(
                _frame(
                    below["bytes"] + top["bytes"],
                    below["images"] + top["images"],
                    below["base64"],
                    below["skipped"],
                    below["data"],
                )
            )
            opaque = F.when(
                top["base64"] & (top["data"] >= 0), F.concat(s["opaque"], F.array(top["data"]))
            ).otherwise(s["opaque"])
            return state(F.concat(beneath, F.array(merged)), none, s["at"], opaque)

        def value():
            text = F.get(texts, s["at"])
            counted = ~skip_here
            image = F.startswith(text, F.lit("data:image"))
            changed = _frame(
                top["bytes"] + F.when(counted & ~image, F.octet_length(text)).otherwise(0),
                top["images"] + F.when(counted & image, 1).otherwise(0),
                top["base64"] | ((s["key"] == "type").eqNullSafe(F.lit(True)) & (text == "base64")),
                top["skipped"],
                F.when((s["key"] == "data").eqNullSafe(F.lit(True)), s["at"]).otherwise(top["data"]),
            )
            return state(F.concat(rest, F.array(changed)), none, s["at"] + 1, s["opaque"])

        return first_of(
            (e.isin("{", "["), state(F.concat(s["stack"], F.array(_frame(skipped=skip_here))), none, s["at"], s["opaque"])),
            (e.isin("}", "]"), closed()),
            (is_key(e), state(s["stack"], F.get(texts, s["at"]), s["at"] + 1, s["opaque"])),
        ).otherwise(value())

    start = state(F.array(_frame()), F.lit(None), F.lit(0), F.array().cast("array<int>")).cast(_STATE)
    return let(
        all_texts,
        lambda texts: F.aggregate(
            events,
            start,
            lambda s, e: step(texts, s, e).cast(_STATE),
            lambda s: F.struct(
                F.element_at(s["stack"], -1)["bytes"].alias("bytes"),
                F.element_at(s["stack"], -1)["images"].alias("images"),
                s["opaque"].alias("opaque"),
            ),
        ),
    )
