import random

import pytest

from llm import language_id as L
from llm.common import in_fold

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then it sleeps under the old tree ",
    "de": "der schnelle braune fuchs springt über den faulen hund und schläft unter dem alten baum ",
}


def plain_symbols(text):
    """Lower-cased letters' bytes, with one space for a run of anything else; none at the start."""
    out = ""
    for c in text:
        if c.isalpha():
            out += c.lower() if len(c.lower()) == 1 else c
        elif out and not out.endswith(" "):
            out += " "
    return out.encode()


def plain_phrases(sequence, piece, train):
    """Longest matches by plain search, piece by piece; a symbol that the sample lacks is a phrase after another such one."""
    count = 0
    for at in range(0, len(sequence), piece):
        held, lacked = b"", False
        for s in sequence[at : at + piece]:
            s = bytes([s])
            if not lacked and held + s in train:
                held += s
            else:
                count += bool(held) or lacked
                held, lacked = (s, False) if s in train else (b"", True)
        count += bool(held) or lacked
    return count


def test_phrases_equal_plain_search():
    import numpy as np

    rng = random.Random(3)
    train = bytes(rng.choice([97, 98, 99, 195]) for _ in range(80))
    table = L.laid(L.charged(L.automaton(list(train))))
    texts = [bytes(rng.choice([97, 98, 99, 100, 195, 255]) for _ in range(n)) for n in (0, 1, 3, 40, L.PIECE, L.PIECE + 1, 3 * L.PIECE + 7)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = L.phrases(np.frombuffer(b"".join(texts), np.uint8), at, [table])[:, 0]
    assert got.tolist() == [plain_phrases(t, L.PIECE, train) for t in texts]


def test_laid_tables_hold_every_transition():
    import numpy as np

    rng = random.Random(8)
    states = [{rng.randrange(256): rng.randrange(1, 900) for _ in range(rng.choice([0, 1, 1, 2, 30]))} for _ in range(500)]
    table = L.laid(states)
    for state, row in enumerate(states):
        got = table(np.full(256, state, np.int32), np.arange(256, dtype=np.int32)).tolist()
        assert got == [row.get(s, 0) for s in range(256)]


def test_streams_equal_plain_symbols():
    import numpy as np

    texts = ["", "  ", "A b..C", "ÄÉx", "\n a", "a😀b", "日本 a", "𐐀", "İx", "Straße"]
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sym, place, letter = L._streams(data, at, L._lookup())
    assert [sym[a:b].tobytes() for a, b in zip(place, place[1:])] == [plain_symbols(t) for t in texts]
    assert letter.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_stretches_reach_from_the_first_to_the_last_symbol():
    text = bytes(range(100, 200))
    assert L.spread(text, 100) == text and L.spread(text, 8) == bytes([100, 101, 32, 132, 133, 32, 165, 166, 32, 198, 199])


def accuracy(docs, make, n=50):
    """Right answers in a hundred on texts that ``make`` (language, random source) writes, other ones than learned from."""
    rng = random.Random(1)
    languages = make("", None)
    learn, ask = [docs([(1000 * k + i, make(lang, rng)) for i in range(40)], lang=lang) for k, lang in enumerate(languages)], []
    for k, lang in enumerate(languages):
        ask += [(k, make(lang, rng)) for _ in range(n)]
    model = L.fit(learn[0].union(learn[1]) if len(learn) == 2 else learn[0].union(learn[1]).union(learn[2]))
    got = L.identify(docs(ask), model).select("doc_id", "lang_pred").collect()
    return 100 * sum(languages[r.doc_id] == r.lang_pred for r in got) / len(got)


def test_a_long_header_that_all_texts_share(docs):
    head = "".join(random.Random(7).choice("abcdefghijklmnop  ") for _ in range(2400))
    words = {k: v.split() for k, v in SAMPLES.items()}
    assert accuracy(docs, lambda lang, rng: ["en", "de"] if rng is None else head + " " + " ".join(rng.choice(words[lang]) for _ in range(30))) >= 95


def test_scripts_of_many_letters(docs):
    words = SAMPLES["en"].split()

    def make(lang, rng):
        if rng is None:
            return ["en", "ja", "zh"]
        if lang == "en":
            return " ".join(rng.choice(words) for _ in range(30))
        first = 0x4E00 if lang == "zh" else 0x5000
        return "".join(chr(first + min(int(rng.expovariate(1 / 250)), 1499)) if rng.random() < 0.9 else "。" for _ in range(120))

    assert accuracy(docs, make) >= 95


@pytest.fixture(scope="module")
def model(docs):
    rows = docs([(i, SAMPLES["en"] * 3) for i in range(4)]).union(docs([(10 + i, SAMPLES["de"] * 3) for i in range(4)], lang="de"))
    return L.fit(rows.union(docs([(20, None)])).union(docs([(21, "x")], lang=None)))


def test_identify_and_odd_rows(docs, model):
    rows = [(1, "the dog sleeps"), (2, "der hund schläft"), (3, None), (4, ""), (5, "123 !?"), (5, "123 !?"), (None, "the fox"), (6, SAMPLES["de"] * 2000)]
    got = L.identify(docs(rows), model).select("doc_id", "text", "lang_pred", "score", "n").collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r for r in got}
    assert [by[k].lang_pred for k in rows[:5]] == ["en", "de", "und", "und", "und"]
    assert by[rows[-1]].lang_pred == "de" and by[(None, "the fox")].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got) and by[rows[2]].score == 0
    assert {r.n for r in got} == {"y"}  # other columns stay


def test_rejected_documents_go_and_columns_stay(docs, model):
    given = docs([(1, "the dog sleeps"), (2, None), (3, "…")])
    kept = L.identified(given, model)
    assert kept.columns == given.columns and [r.doc_id for r in kept.collect()] == [1]
    assert kept.first().score == "x"


def test_no_labels_and_no_rows(docs, model):
    none = L.fit(docs([]))
    assert none.languages == []
    assert [r.lang_pred for r in L.identify(docs([(1, "abc")]), none).collect()] == ["und"]
    assert L.identify(docs([]), model).count() == 0


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = in_fold("doc_id", 5, 0)
    model = L.fit(rows.where(~held))
    got = L.identify(rows.where(held), model).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_a_stray_short_label_wins_no_text(docs):
    rows = docs([(i, SAMPLES["en"] * 3) for i in range(4)]).union(docs([(10 + i, SAMPLES["de"] * 3) for i in range(4)], lang="de"))
    rows = rows.union(docs([(20, "ok")], lang="aa")).union(docs([(21, "hello world")], lang="zz"))
    texts = [("en", SAMPLES["en"]), ("en", "the dog sleeps under the tree"), ("de", SAMPLES["de"]), ("de", "der hund schläft"), ("en", "o")]
    got = L.identify(docs([(i, t) for i, (_, t) in enumerate(texts)]), L.fit(rows)).select("doc_id", "lang_pred").collect()
    assert [r.lang_pred for r in sorted(got)][:4] == [lang for lang, _ in texts[:4]]
    assert sorted(got)[4].lang_pred != "aa"  # of equal costs, the language with more text


def test_less_labelled_text_never_lowers_the_cost():
    import numpy as np

    rng = random.Random(5)
    train = [rng.randrange(97, 105) for _ in range(400)]
    text = np.array([rng.randrange(95, 105) for _ in range(1500)], np.uint8)
    tables = [L.laid(L.charged(L.automaton(train[:n]))) for n in (1, 2, 5, 20, 100, 400)]
    cost = L.phrases(text, np.array([0, len(text)]), tables)[0].tolist()
    assert cost == sorted(cost, reverse=True)


def test_short_clean_texts_stay_whatever_the_number_of_languages(docs, model):
    rows = docs([(i, SAMPLES["en"]) for i in range(4)])
    for lang in ("de", "fr", "it", "nl", "sv"):
        rows = rows.union(docs([(10, SAMPLES["en"])], lang=lang))
    given = docs([(1, "the"), (2, "A"), (3, "1 !")])
    assert sorted(r.doc_id for r in L.identified(given, L.fit(rows)).collect()) == [1, 2]
