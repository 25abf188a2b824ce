"""URL rules and quality rules against plain versions."""

import random
import re
from collections import Counter

from llm import quality_rules as Q
from llm import url_rules as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/x/", "allow"), ("a.example.org", "", "block"), ("com", "/de/", "block"), ("b.com", "/", "allow")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain(url, rules):
    host, path = split(url)
    fits = [(len(h.split(".")), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


def judged(spark, rows, rules):
    pages = spark.createDataFrame([(i, u, "own", "own") for i, u in rows], "page_id long, url string, host string, rule string")
    made = U.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return sorted(((r.row.page_id, r.host, r.path, r.rule, r.verdict) for r in made.collect()), key=str)


def test_urls_equal_plain_search(spark):
    rng = random.Random(4)
    hosts = ["example.org", "x.example.org", "a.example.org", "q.a.example.org", "notexample.org", "b.com", "c.b.com", "COM", "x.net", "", "org", "example.org:80"]
    paths = ["", "/", "/es", "/es/", "/es/x/y", "/de/1", "/en?x=/es/", "#/es/", "/es/x"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(300)]
    rows += [(900, None), (901, ""), (902, "no scheme/org"), (903, "a://b://example.org/"), (904, "http://x.org/" + "y" * 5000), (904, "http://x.org/\n/es/")]
    assert judged(spark, rows, RULES) == sorted(((i, *plain(u, RULES)) for i, u in rows), key=str)


def test_many_nested_rules(spark):
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))
    rules = list({(host(), path()): rng.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    rows = [(i, f"s://{host()}{path()}") for i in range(400)]
    assert judged(spark, rows, rules) == sorted(((i, *plain(u, rules)) for i, u in rows), key=str)


def test_no_rules_or_pages(spark):
    assert judged(spark, [], RULES) == []
    assert judged(spark, [(1, "http://a.org/")], []) == [(1, "a.org", "/", None, "allow")]
    assert judged(spark, [(1, "http://a.org/")], [(None, "/", "block"), ("ORG", "/", "allow"), ("org", "/", "block")]) == [(1, "a.org", "/", "org/", "block")]


WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans(U.UPPER, U.LOWER)


def measured(rows):
    hosts = Counter(h for h, _ in {(h or "", i) for i, _, h in rows})
    lines = lambda t: [x for x in (t or "").split("\n") if WORD.search(x)]
    norm = lambda x: " ".join(WORD.findall(x)).translate(ASCII)
    seen = Counter((h, x) for h, x, _ in {(h or "", norm(x), i) for i, t, h in rows for x in lines(t)})
    out = []
    for i, t, h in rows:
        w, text = WORD.findall(t or ""), t or ""
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        again = len({j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)})
        most = max(Q.LINE_DOCS, hosts[h or ""] // Q.HOST_SHARE)
        left = len(w) - sum(len(WORD.findall(x)) for x in lines(t) if seen[h or "", norm(x)] > most)
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), len(lines(t)) - len(set(lines(t))), again, failed, left, not failed and 100 * left >= Q.LEAST_LEFT * len(w)))
    return sorted(out, key=str)


def test_quality_equals_plain_counts(spark):
    rng = random.Random(6)
    common = [" ".join(f"common{j}x{i}" for i in range(12)) for j in range(4)]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(0, 8))]
        rows.append((i, "\n".join(own + rng.sample(common, rng.randint(0, 4)) + own[:1]), rng.choice(["h", "h", "g"])))
    rows += [(200, None, "h"), (201, "", None), (202, " \n\t\n", "h"), (203, "a a a a a", "h"), (204, "# $ < é😀\u3000x", None), (None, common[0].upper() + "\n" + common[1], "h"), (205, "x y " * 30_000, "g")]
    rows += [(206, "\n".join(common) + "\n" + "z " * 60, "h")] * 2
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, source string, host string")
    got = Q.judge(df.drop("host")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept").collect()
    assert sorted(map(tuple, got), key=str) == measured(rows)
    assert Q.judge(df).count() == len(rows) and Q.judge(df.limit(0)).count() == 0
    assert {r[8] for r in measured(rows)} == {True, False} and any(r[7] < r[1] for r in measured(rows))


def test_rows_of_one_document_count_once(spark):
    shared = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, shared + "\n" + " ".join(f"own{i}x{j}" for j in range(20)), "h") for i in range(8)]
    rows += [rows[0]] * 15 + [(None, shared, "h")] * 9
    rows += [(i, "\n".join(["one line that twenty-five have", shared, f"mine {i}"]), "g") for i in range(25)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = sorted(map(tuple, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept").collect()), key=str)
    assert got == measured(rows)
    assert all(r[7] == r[1] for r in got if r[1] != 67) and all(r[7] < r[1] for r in got if r[1] == 67)
