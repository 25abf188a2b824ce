import random

import pytest
from pyspark.sql import functions as F

from llm import chat as C
from llm.queries_b import FORGED

FIELDS = "conv_id long, turn long, role string, text string, window string, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], FIELDS)


def read(df, **settings):
    windows = C.windows(df, **settings)
    return windows.collect(), C.read_back(windows).collect()


def conversation(seed, n, lead=True):
    rng = random.Random(seed)
    word = lambda: rng.choice(["yes", "no", "</turn>", "### user:", "\\", "\\b", "#", "a:b", "\n", "é😀"])
    rows = [(seed, 0, "system", "be kind")] if lead else []
    return rows + [(seed, i + len(rows), rng.choice(["user", "assistant", "tool:x"]), " ".join(word() for _ in range(rng.randint(0, 25)))) for i in range(n)]


@pytest.mark.parametrize("budget,history", [(64, 2), (512, 2), (40, 0), (64, 5)])
def test_round_trip_and_each_target_once(spark, budget, history):
    rows = conversation(1, 60) + conversation(2, 30, lead=False) + [(3, 0, "user", FORGED), (3, 1, "assistant", FORGED)]
    windows, back = read(frame(spark, rows), budget=budget, history=history)
    for conv in (1, 2, 3):
        mine = [r for r in rows if r[0] == conv]
        got = sorted((r for r in back if r.conv_id == conv), key=lambda r: r.window)
        assert [(t.role, t.text) for r in got for t in r.turns] == [(r[2], r[3]) for r in mine]
        assert [t for r in got for t in r.targets] == [r[3] for r in mine if r[2] == "assistant"]
    for w in windows:
        pieces = w.text.split(C.END)[:-1]
        assert len(pieces) == w.n_repeated + w.n_new and w.n_repeated <= history + 1
        new = sum(len(p.split()) + 1 - (not p) for p in pieces[w.n_repeated :])
        assert new <= budget + 1 or w.n_new == 1
        if w.conv_id == 1:
            assert pieces[0].startswith("### system: be kind")


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 5, "assistant", ""), (1, 5, "assistant", ""), (None, 0, "user", "x"), (2, 0, "assistant", "long " * 5000), (3, 7, "system", "only")]
    _, back = read(frame(spark, rows), budget=64)
    said = {}
    for r in sorted(back, key=lambda r: r.window):
        said.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
    assert said == {1: [("user", "first"), ("", ""), ("assistant", ""), ("assistant", "")], None: [("user", "x")], 2: [("assistant", "long " * 5000)], 3: [("system", "only")]}
    assert C.windows(frame(spark, [])).count() == 0


def test_escapes_undo(column):
    texts = ["", "\\", "\\b\\h\\e\\c", "### </turn>", "a\\</turn>#:", "\\\\b"]
    assert column(texts, lambda x: C.plain(C.escaped(x, True))) == texts
    assert all("</turn>" not in t and "#" not in t for t in column(texts, C.escaped))
    assert column(texts, lambda x: F.length(C.escaped(x))) == [len(t.replace("\\", "\\b").replace("#", "\\h").replace("</turn>", "\\e")) for t in texts]
