from collections import defaultdict

from plain_versions import WORD, corpus, plain, shingles

from llm import paragraphs as P


def paragraph(n, seed):
    return corpus(seed, 1, 1, 0)[0][1] if n is None else " ".join(f"p{seed}x{i}" for i in range(n))


def want(rows, least=P.LEAST_WORDS):
    units = {(i, j): line for i, t in rows for j, line in enumerate((t or "").split("\n")) if len(WORD.findall(line)) >= least}
    names = {u: n for n, u in enumerate(sorted(units))}
    root = plain([(names[u], line) for u, line in units.items()], 5, 80)
    groups = defaultdict(list)
    for u, n in names.items():
        groups[root[n][1]].append(u)
    return {u: (min(g), u != min(g)) for g in groups.values() if len(g) > 1 for u in g}


def result(df):
    return {(r.doc_id, r.line): ((r.keep_doc, r.keep_line), r.removed) for r in df.collect()}


def test_equals_all_pairs(docs):
    texts = [t for _, t in corpus(11, 25, 5, 2)]
    rows = [(i, "\n".join(texts[(i * 3 + j) % len(texts)] for j in range(4))) for i in range(25)]
    assert result(P.repeats(docs(rows))) == want(rows)


def test_a_passage_shared_by_many(docs):
    shared = paragraph(60, 1)
    rows = [(i, f"{paragraph(30, 100 + i)}\n{shared}\nshort line") for i in range(40)]
    got = result(P.repeats(docs(rows)))
    assert got == want(rows) and sum(removed for _, removed in got.values()) == 39


def test_odd_rows_and_rebuilt_texts(docs):
    a, b = paragraph(25, 1), paragraph(25, 2)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, a), (5, f"x\n{a}\n\n{b}\n"), (6, f"{b}\n{b}"), (7, "one two")]
    given = docs(rows + [(4, a)])
    assert result(P.repeats(given)) == want(rows)
    out = P.without_repeats(given)
    assert out.columns == given.columns and out.count() == 8
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {1: None, 2: "", 3: "\n\n", 4: a, 5: f"x\n\n{b}\n", 6: "", 7: "one two"}


def test_bands_reach_the_recall():
    n = P.bands(80)
    assert 1 - (1 - 0.8**P.ROWS) ** n >= P.RECALL > 1 - (1 - 0.8**P.ROWS) ** (n - 1)


def test_no_rows(docs):
    assert P.repeats(docs([])).count() == 0
    assert shingles("") == frozenset()


def test_short_lines_are_compared_down_to_the_shingle_size(docs):
    rows = [(1, "accept all cookies to continue\n" + paragraph(4, 1)), (2, f"{paragraph(4, 1)}\nAccept all cookies to continue\n{paragraph(30, 2)}"), (3, paragraph(19, 3)), (4, paragraph(19, 3))]
    got = result(P.repeats(docs(rows)))
    assert got == want(rows)
    assert got == {(1, 0): ((1, 0), False), (2, 1): ((1, 0), True), (3, 0): ((3, 0), False), (4, 0): ((3, 0), True)}


def repeated_windows(rows, size):
    """Windows of ``size`` words by their text, with the (doc_id, first word) that have them, if more than one."""
    at = defaultdict(set)
    for i, t in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")]
        for j in range(len(words) - size + 1):
            at[tuple(words[j : j + size])].add((i, j))
    return {w: places for w, places in at.items() if len(places) > 1}


def test_passages_are_found_inside_lines_and_across_breaks(docs):
    a, b, c = paragraph(P.PASSAGE, 1), paragraph(70, 2), paragraph(120, 3)
    words = b.split()
    rows = [
        (1, f"{paragraph(15, 10)} {a} {paragraph(40, 11)}"), (2, f"{paragraph(33, 12)} {a.upper()} {paragraph(200, 13)}"),
        (3, f"{paragraph(9, 14)}\n" + "\n".join(" ".join(words[i : i + 4]) for i in range(0, 70, 4))), (4, f"one\ntwo {paragraph(8, 15)} {b}"),
        (5, f"{c} {paragraph(60, 16)} {c}"), (6, paragraph(300, 17)), (7, None), (8, "x " * 90), (9, f"{paragraph(29, 18)}"), (10, f"{paragraph(29, 18)}"), (None, f"{a} {paragraph(5, 19)}"),
    ]
    got = P.passages(docs(rows + [(6, paragraph(300, 17))])).collect()
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.word, r.word + r.n_words))
    assert set(spans) == {None, 1, 2, 3, 4, 5, 8}
    # A run of PASSAGE words that repeats has a window among the rows at each of its places.
    for places in repeated_windows(rows, P.PASSAGE).values():
        for i, j in places:
            assert any(max(j, x) + P.GRAM <= min(j + P.PASSAGE, y) for x, y in spans[i]), (i, j)
    # All words of a row are in windows of GRAM words that repeat.
    covered = {(i, j + x) for places in repeated_windows(rows, P.GRAM).values() for i, j in places for x in range(P.GRAM)}
    assert all((i, x) in covered for i, both in spans.items() for lo, hi in both for x in range(lo, hi))
    keep = {r.doc_id: (r.keep_doc, r.keep_line, r.removed) for r in got if r.doc_id in (None, 1, 2, 3, 4)}
    assert keep[None] == (None, 0, False) and keep[1] == keep[2] == (None, 0, True)
    assert not keep[3][2] and keep[3][1] > 0 and keep[4] == (*keep[3][:2], True)
    assert {r.line for r in got if r.doc_id == 4} == {1}
    assert {(r.removed, r.word >= 180) for r in got if r.doc_id == 5} == {(False, False), (True, True)}


def test_no_passages(docs):
    assert P.passages(docs([])).count() == 0
    assert P.passages(docs([(1, paragraph(80, 1)), (1, paragraph(80, 1)), (2, ""), (3, None)])).count() == 0
