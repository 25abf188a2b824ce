"""Tasks work on bounded pieces of their batches, and a waiting worker keeps little."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa

from llm import common, language_id, mixture, ngram_join, substrings

MB = 1 << 20


def texts(size):
    rng = np.random.default_rng(3)
    word = lambda: bytes(rng.integers(97, 123, 6, np.uint8)).decode()
    words = [word() for _ in range(4000)]
    return [" ".join(words[i] for i in rng.integers(0, len(words), 300)) for _ in range(size // 2100 + 1)]


def most(work):
    """The most memory that is in use at a time while ``work`` runs, in bytes."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sets_of_a_large_batch_are_made_piece_by_piece(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", {})
    batch = pa.RecordBatch.from_arrays([pa.array(texts(4 * MB))], ["text"])
    assert most(lambda: [None for _ in ngram_join._sets(batch, 3)]) < 60 * MB


def test_phrases_take_a_few_bytes_a_symbol():
    sym = np.frombuffer(" ".join(texts(4 * MB)).encode(), np.uint8)
    at = np.arange(0, len(sym) + 1, 2000)
    table = language_id.laid(language_id.charged(language_id.automaton(sym[:2000].tolist())))
    assert most(lambda: language_id.phrases(sym, at, [table])) < 6 * len(sym)


def test_symbols_are_those_of_the_whole():
    given = [None, "", "Ünï \U00010400\U0001042c x" * 3000, "\U0001f600", "12 a", *texts(MB), None]
    data, at = common.buffers(pa.array(given))
    lookup = language_id._lookup()
    for got, want in zip(language_id._symbols(data, at, lookup), language_id._streams(data, at, lookup)):
        assert got.tolist() == want.tolist()


def test_a_worker_gives_memory_back(monkeypatch):
    released = []
    pool = type("Pool", (), {"release_unused": lambda self: released.append(1)})
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool())
    work = common.tidy(lambda batches: (b + 1 for b in batches))
    assert list(work(iter([1, 2]))) == [2, 3] and released == [1]


def test_weights_need_no_python_workers(spark):
    leaves = spark.createDataFrame(pa.table({"a": ["x", "y"], "b": ["u", "u"], "n_tokens": [10, 20]}))
    asked = []
    real = spark.createDataFrame
    try:
        spark.createDataFrame = lambda data, *more, **named: asked.append(type(data)) or real(data, *more, **named)
        rows = mixture.budgets(leaves, ["a", "b"], {("x",): 3, ("y", "u"): 2}, 20, 4).collect()
    finally:
        del spark.createDataFrame
    assert asked == [pa.Table, pa.Table]
    assert {r.a: r.budget for r in rows} == {"x": 15, "y": 5}


def test_an_identified_row_stays_as_it_is(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", "s", 3), (2, "12", None, None, None)], "doc_id long, text string, lang string, source string, length int")
    model = language_id.fit(docs)
    for given in (docs, docs.select("text", "doc_id"), docs.select("text")):
        out = language_id.identified(given, model)
        assert out.columns == given.columns and out.collect() == given.limit(1).collect()


def test_segments_of_a_large_batch_are_cut_piece_by_piece(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", {})
    data, at = common.buffers(pa.array(texts(4 * MB)))
    assert most(lambda: [None for _ in substrings.segments(data, at, 400, 128)]) < 60 * MB


def test_symbols_of_a_shard_stay_narrow(monkeypatch):
    seen = []
    real = substrings.repeated.__globals__["suffix_array"]
    monkeypatch.setitem(substrings.repeated.__globals__, "suffix_array", lambda t, k: seen.append(t.dtype) or real(t, k))
    assert [x.tolist() for x in substrings.repeated([b"abcabc", b"\xffab"], 3)] == [[True, False, False, True], [False]]
    assert seen == [np.uint16]


def removal(given):
    items = [[{"start": 0, "n": 2}, {"start": 1500, "n": 1}] if i % 2 else [{"start": i % 1000, "n": 1}] for i in range(len(given))]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array([b"%d" % i for i in range(len(given))]), pa.array(given), pa.array(items, kind)], ["name", "text", "items"])


def test_texts_of_a_large_batch_are_cut_part_by_part():
    batch = removal(texts(8 * MB))
    assert most(lambda: [None for _ in substrings._remove(400)(iter([batch]))]) < 4 * MB


def test_parts_of_a_batch_have_their_own_items(monkeypatch):
    given = texts(MB // 4)[:100]
    monkeypatch.setattr(substrings, "_TEXTS", 5000, raising=False)
    want = []
    for i, t in enumerate(given):
        kept = t[401:1500] + t[1900:] if i % 2 else t[:i] + t[i + 400 :]
        want.append((b"%d" % i, len(t) - len(kept), 1 + i % 2, hashlib.sha256(kept.encode()).hexdigest(), kept.encode()))
    out = list(substrings._remove(400)(iter([removal(given)])))
    assert len(out) > 20 and [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_a_text_comes_once_of_a_task_in_small_parts(monkeypatch):
    monkeypatch.setattr(substrings, "_TEXTS", 5000, raising=False)
    given = texts(MB // 4)[:60]
    names = [hashlib.sha256(t.encode()).digest()[:16] for t in given]
    batch = pa.RecordBatch.from_arrays([pa.array(names + names[::-1] + names), pa.array(given + given[::-1] + given)], ["name", "text"])
    out = list(substrings._once(iter([batch.slice(3, 100), batch])))
    assert [(r["name"], r["text"]) for b in out for r in b.to_pylist()] == [*zip(names[3:], given[3:]), *zip(names[:3], given[:3])]
    assert max(b.nbytes for b in out) < 8000


def test_substrings_take_one_worker_a_task_that_gives_memory_back(spark, monkeypatch):
    plans, tidied = {}, set()
    real, tidy = substrings.stored, common.tidy
    monkeypatch.setattr(substrings, "stored", lambda df, label: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or real(df, label))
    monkeypatch.setattr(substrings, "tidy", lambda work: tidied.add(work.__name__) or tidy(work), raising=False)
    substrings.repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert {label: plan.count("MapInArrow") for label, plan in plans.items() if "MapInArrow" in plan} == {"segments": 1, "texts": 1, "classes": 1, "pieces": 1, "strings": 1}
    assert tidied == {"_once", "cut", "name", "take", "sort", "digests", "remove"}
