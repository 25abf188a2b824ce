"""SQL text of the secret and e-mail rules for the comparison engine.

The pattern texts are the rules' own; what the callbacks decide is said again in SQL.
"""

from __future__ import annotations

from logferry.functions import values as V
from logferry.functions.secrets import EMAIL, NOT_PLAIN_WORD, RULES, VALUE_LINE, Rule


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def alternatives(words) -> str:
    return "(?:" + "|".join(words) + ")"


def one_of(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


def secret_key(k: str) -> str:
    spaced = rf"regexp_replace({k}, '([a-z])([A-Z])', '\1 \2', 'g')"
    words = f"lower(regexp_replace({spaced}, '[^A-Za-z0-9]+', ' ', 'g'))"
    pattern = f"(?:^| ){alternatives(V.SECRET_WORDS)}(?: |$)|(?:^| ){alternatives(V.KEY_PREFIXES)} key(?: |$)"
    return f"regexp_matches({words}, {quote(pattern)})"


def placeholder(v: str, k: str) -> str:
    t = rf"lower(regexp_replace({v}, '^\s+|\s+$', '', 'g'))"
    return (
        f"(strlen({t}) < 4 OR regexp_matches({t}, {quote('^(?:' + V.PLACEHOLDER + ')$')}) OR contains(lower({k}), {t}))"
    )


def type_word(v: str) -> str:
    return f"lower({v}) IN {one_of(V.TYPE_WORDS)}"


def _accepts(rule: Rule) -> str:
    if rule.name == "auth-header":
        return "CASE WHEN starts_with(pre[i], 'Bearer') THEN length(val[i]) >= 16 ELSE regexp_matches(val[i], '[0-9=+/]') END"
    if rule.name == "config-secret":
        return f"{secret_key('key[i]')} AND NOT {placeholder('val[i]', 'key[i]')} AND NOT {type_word('val[i]')}"
    if rule.name == "secret-assignment":
        wordy = "strlen(val[i]) >= 6 AND regexp_matches(val[i], '[A-Za-z]') AND regexp_matches(val[i], '[^A-Za-z_.-]')"
        return f"{secret_key('key[i]')} AND (suf[i] <> '' OR ({wordy})) AND NOT {placeholder('val[i]', 'key[i]')}"
    return "true"


def _group(rule: Rule, name: str) -> str:
    return f"regexp_extract_all(t, {quote(rule.pattern)}, {rule.groups[name]})"


def rule_steps(source: str, id_: str = "doc_id") -> str:
    """CTEs r0 … rN: ``id, t, found``, one per rule, each on the previous one's text."""
    out = [f"r0 AS MATERIALIZED (SELECT {id_}, text AS t, CAST([] AS STRUCT(rule VARCHAR, value VARCHAR)[]) AS found FROM {source})"]
    for n, rule in enumerate(RULES):
        add = f"lambda v: {{'rule': {quote(rule.name)}, 'value': v}}"
        if rule.accept is None:
            p = quote(rule.pattern)
            out.append(
                f"r{n + 1} AS MATERIALIZED (SELECT {id_}, regexp_replace(t, {p}, {quote(rule.marker)}, 'g') AS t, "
                f"list_concat(found, list_transform(regexp_extract_all(t, {p}), {add})) AS found FROM r{n})"
            )
            continue
        cols = {k: _group(rule, k) for k in rule.groups}
        if "quoted" in cols:
            q = cols.pop("quoted")
            edge = "CASE WHEN left(x, 1) IN ('''', '\"') THEN left(x, 1) ELSE '' END"
            cols["pre"] = f"list_transform(list_zip({_group(rule, 'prefix')}, {q}), lambda z: z[1] || {edge.replace('x', 'z[2]', 1).replace('left(x', 'left(z[2]')})"
            cols["val"] = f"list_transform({q}, lambda x: CASE WHEN left(x, 1) IN ('''', '\"') THEN substr(x, 2, length(x) - 2) ELSE x END)"
            cols["suf"] = f"list_transform({q}, lambda x: {edge})"
        else:
            cols["pre"], cols["val"], cols["suf"] = cols["prefix"], cols["value"], cols["suffix"]
        cols = {k: c for k, c in cols.items() if k in ("pre", "val", "suf", "key")}
        listed = ", ".join(f"{c} AS {k}" for k, c in cols.items())
        out.append(
            f"m{n + 1} AS MATERIALIZED (SELECT {id_}, t, found, string_split_regex(t, {quote(rule.pattern)}) AS segs, {listed} FROM r{n})"
        )
        out.append(
            f"o{n + 1} AS MATERIALIZED (SELECT *, list_transform(range(1, len(val) + 1), lambda i: {_accepts(rule)}) AS ok FROM m{n + 1})"
        )
        piece = f"coalesce(pre[i] || CASE WHEN ok[i] THEN {quote(rule.marker)} ELSE val[i] END || suf[i], '')"
        out.append(
            f"r{n + 1} AS MATERIALIZED (SELECT {id_}, array_to_string(list_transform(range(1, len(segs) + 1), lambda i: segs[i] || {piece}), '') AS t, "
            f"list_concat(found, list_transform(list_filter(range(1, len(val) + 1), lambda i: ok[i]), lambda i: {{'rule': {quote(rule.name)}, 'value': val[i]}})) AS found FROM o{n + 1})"
        )
    return ",\n".join(out)


LAST = f"r{len(RULES)}"


def email_steps(source: str, id_: str = "doc_id", text: str = "t", keep: str = "") -> str:
    """CTEs e0, e1: ``masked`` text and ``n`` replaced e-mails; ``keep`` adds ``, expression AS name``."""
    kept = ", " + keep.rsplit(" ", 1)[-1] if keep else ""
    p = quote(EMAIL)
    left = "(starts_with(m[i], 'git@') OR starts_with(m[i], 'noreply@') OR regexp_matches(host[i], '^[0-9]+x$'))"
    return (
        f"e0 AS MATERIALIZED (SELECT {id_}{keep}, string_split_regex({text}, {p}) AS segs, "
        f"regexp_extract_all({text}, {p}, 1) AS m, regexp_extract_all({text}, {p}, 2) AS host FROM {source}),\n"
        f"e1 AS MATERIALIZED (SELECT {id_}{kept}, array_to_string(list_transform(range(1, len(segs) + 1), "
        f"lambda i: segs[i] || CASE WHEN m[i] IS NULL THEN '' WHEN {left} THEN m[i] ELSE '[email]' END), '') AS masked, "
        f"len(list_filter(range(1, len(m) + 1), lambda i: NOT {left})) AS n FROM e0)"
    )


def first_rule(text: str, strong_only: bool) -> str:
    """CASE over the rules in order, each on the original text."""
    cases = []
    for rule in RULES:
        if strong_only and not rule.strong:
            continue
        if rule.accept is None or rule.name in ("aws-secret-key", "azure-key"):
            cases.append(f"WHEN regexp_matches({text}, {quote(rule.pattern)}) THEN {quote(rule.name)}")
        else:
            cases.append(f"WHEN hit_{rule.name.replace('-', '_')} THEN {quote(rule.name)}")
    return "CASE " + " ".join(cases) + " END"


def callback_hits(source: str, id_: str = "doc_id") -> str:
    """CTE ``hits``: whether each callback rule fires on the original text."""
    parts, cols = [], []
    for rule in RULES:
        if rule.accept is None or rule.name in ("aws-secret-key", "azure-key"):
            continue
        name = "hit_" + rule.name.replace("-", "_")
        groups = {k: f"regexp_extract_all(text, {quote(rule.pattern)}, {g})" for k, g in rule.groups.items()}
        if "quoted" in groups:
            q = groups["quoted"]
            sets = [
                f"{groups['key']} AS key",
                f"list_transform({q}, lambda x: CASE WHEN left(x, 1) IN ('''', '\"') THEN substr(x, 2, length(x) - 2) ELSE x END) AS val",
                f"list_transform({q}, lambda x: CASE WHEN left(x, 1) IN ('''', '\"') THEN left(x, 1) ELSE '' END) AS suf",
            ]
        else:
            sets = [f"{groups['prefix']} AS pre", f"{groups['value']} AS val", f"{groups['suffix']} AS suf"]
            if "key" in groups:
                sets.append(f"{groups['key']} AS key")
        parts.append(
            f"x_{name} AS (SELECT {id_}, len(list_filter(range(1, len(val) + 1), lambda i: {_accepts(rule)})) > 0 AS {name} "
            f"FROM (SELECT {id_}, {', '.join(sets)} FROM {source}))"
        )
        cols.append(name)
    joined = " ".join(f"JOIN x_{c} USING ({id_})" for c in cols)
    parts.append(f"hits AS MATERIALIZED (SELECT s.{id_}, s.text, {', '.join(cols)} FROM {source} s {joined})")
    return ",\n".join(parts)


def learned(text: str) -> str:
    """List of secret values in a text."""
    strong = [f"regexp_extract_all({text}, {quote(r.pattern)})" for r in RULES if r.strong]
    found = f"regexp_extract_all({text}, {quote(VALUE_LINE)}, 1)"
    for s in strong:
        found = f"list_concat({found}, {s})"
    return (
        f"list_filter({found}, lambda v: regexp_matches(v, {quote(NOT_PLAIN_WORD)}) AND NOT regexp_matches(v, '^[0-9.]*$') "
        "AND NOT regexp_matches(v, '^[/~.]') AND NOT contains(v, '://'))"
    )
