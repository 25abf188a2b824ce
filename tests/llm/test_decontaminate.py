import random

from llm import decontaminate as D


def distance(pattern, text):
    """Least edit distance to any part of the text, and the first end, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min((d, j) for j, d in enumerate(row))


def test_myers_equals_the_plain_table():
    rng = random.Random(1)
    for _ in range(400):
        pattern = [rng.choice("abc") for _ in range(rng.choice([1, 5, 70]))]
        text = [rng.choice("abc") for _ in range(rng.randint(0, 90))]
        assert D.myers(pattern, text) == distance(pattern, text)


def plain(rows, items, percent=20, least=1):
    out = set()
    for d, t in rows:
        for i, item in items:
            w = D.words(item)
            if d is not None and i is not None and len(w) >= least:
                n, end = distance(w, D.words(t))
                if n <= len(w) * percent // 100:
                    out.add((d, i, n, end))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 9))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 40)))) for i in range(12)]
    rows = []
    for d in range(60):
        text = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(part))
                part[at : at + 1] = rng.choice([[], [word()], [word(), part[at]]]) if len(part) > 1 else part[at : at + 1]
            at = rng.randint(0, len(text))
            text[at:at] = part
        rows.append((d, " ".join(text)))
    return rows, items


def test_equals_the_plain_table(spark, docs):
    rows, items = corpus(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in D.matches(docs(rows), bench).collect()}
    assert {(d, i, n) for d, i, n, _ in got} == {(d, i, n) for d, i, n, _ in plain(rows, items)} and len(got) > 10


def test_several_passes_give_the_same(spark, docs, monkeypatch):
    rows, items = corpus(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in D.matches(docs(rows), bench).collect()}
    clean = {r.doc_id for r in D.without_matches(docs(rows), bench).collect()}
    monkeypatch.setattr(D, "PASS_CHARS", 300)
    assert {tuple(r) for r in D.matches(docs(rows), bench).collect()} == one
    assert {r.doc_id for r in D.without_matches(docs(rows), bench).collect()} == clean == {d for d, _ in rows} - {m[0] for m in one}


def test_odd_rows(spark, docs):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "too short"), (5, "?!"), (None, item)], "item_id long, text string")
    rows = [(1, f"X {item.upper()}!! y"), (2, None), (3, ""), (4, "too short"), (5, item.replace("two", "2").replace("six ", "")), (6, "w " * 50_000 + item), (7, item.replace("two", "").replace("six", "").replace("ten", ""))]
    got = sorted(tuple(r) for r in D.matches(docs(rows), bench).collect())
    assert got == [(1, 1, 0, 11), (4, 4, 0, 2), (5, 1, 2, 9), (6, 1, 0, 50_010)]
    kept = D.without_matches(docs(rows + [(1, item)]), bench)
    assert kept.columns == docs(rows).columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 7]


def test_no_rows(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs([(1, "a")]), bench).count() == 0 and D.without_matches(docs([(1, "a")]), bench).count() == 1
    assert D.matches(docs([]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_short_items_and_unspaced_scripts_equal_the_plain_table(spark, docs):
    rng = random.Random(9)
    letters = "的一是不了人我在有他这为之大来以个中上们"
    clause = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    items = [(1, "the secret answer is"), (2, "yes"), (3, "two words"), (4, "，".join(clause() for _ in range(3))), (5, "人"), (6, "ภาษาไทย"), (7, "カタカナ and kana")]
    rows = [(i, "".join(rng.choice([clause(), "，", " x "]) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    rows += [(100, "They said: The SECRET answer is, well"), (101, "the secretanswer is"), (102, "yesterday; two  words"), (103, "a" + items[3][1] + "b"), (104, items[3][1].replace("，", "")), (105, "xภาษาไทยy"), (106, "カタカナ and")]
    got = {tuple(r) for r in D.matches(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain(rows, items)
    assert {r[:3] for r in got} == {r[:3] for r in want}
    assert {(100, 1, 0), (102, 3, 0), (103, 4, 0), (104, 4, 0), (105, 6, 0)} <= {r[:3] for r in got} and not [r for r in got if r[:2] in {(101, 1), (102, 2)}]


def test_rows_of_one_id_are_one_document(spark, docs):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "y")], "item_id long, text string, doc_id string")
    rows = [(1, item), (1, item), (1, "z " + item.replace("two", "2")), (None, item), (None, "y " + item.replace("six", "6"))]
    assert sorted((tuple(r) for r in D.matches(docs(rows), bench).collect()), key=str) == [(1, 1, 0, 10), (None, 1, 0, 10)]
    assert D.without_matches(docs(rows), bench).count() == 0
