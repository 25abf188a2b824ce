import hashlib
import re

import public_tokenizers
from plain_versions import WORD, plain, shared_out, token_rows

import corpus_pipeline
from llm import decontaminate, language_id, queries_a
from llm.common import in_fold

FOLDER = "/root/testdata/sf0.001"


def domain(source):
    digit = hashlib.md5((source or "").encode()).hexdigest()[0]
    return "d0" if digit < "6" else "d1" if digit < "b" else "d2"


def cut(drawn, budget, rows):
    """(doc_id, text) of the drawn rows, the last one of a leaf's last pass cut to the leaf's budget."""
    none = lambda x: "(none)" if x is None else x
    leaf = lambda i: (domain(rows[i].source), none(rows[i].lang), none(rows[i].source))
    size = lambda i: len(WORD.findall(rows[i].text))
    out, last = [], {}
    for i, epoch in drawn:
        last[leaf(i)] = max(last.get(leaf(i), 0), epoch)
    for i, epoch in drawn:
        mine = [(j, e) for j, e in drawn if leaf(j) == leaf(i)]
        key = lambda j, e=epoch: hashlib.md5(f"{queries_a.SEED}:{e}:{j}".encode()).hexdigest()
        over = sum(size(j) for j, _ in mine) - budget[leaf(i)]
        words = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", rows[i].text)
        ends = epoch == last[leaf(i)] and over > 0 and key(i) == max(key(j) for j, e in mine if e == epoch)
        out.append((i, "".join(words[: len(words) - over]) if ends else rows[i].text))
    return out


def test_run_equals_the_plain_stages(spark, tmp_path):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(9001, None, "en", "src1", 0), (9002, "12 !? 3", None, None, 7), (9003, "", "de", None, 0), (9004, given.first().text + " zz", None, "src2", 1)]
    folder = str(tmp_path)
    given.union(spark.createDataFrame(odd, given.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.fit(docs.where(~in_fold("doc_id", 5, 0)))
    named = {r.doc_id for r in language_id.identify(docs.select("doc_id", "text"), model).collect() if r.lang_pred != "und"}
    kept = {i: rows[i] for i in named}
    root = plain([(i, r.text) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if root[i][1] == i}
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = lambda text: any(decontaminate.myers(w, text)[0] <= len(w) // 5 for w in items if w)
    kept = {i: r for i, r in kept.items() if not held(decontaminate.words(r.text))}
    assert 0 < len(kept) < len(named) < len(rows)
    budget, drawn = shared_out([(i, r.text, (domain(r.source), r.lang, r.source)) for i, r in kept.items()], queries_a.WEIGHTS, queries_a.SEED, None, queries_a.EPOCHS)
    want = token_rows(cut(drawn, budget, rows), public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect()), key=lambda r: r[1])
    assert got == want


def test_stages_keep_columns_and_take_odd_tables(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema.add("domain", "string").add("row", "string").add("score", "double")
    odd = [(1, None, None, None, None, "x", "y", 0.5), (2, "", "en", "s", 0, None, None, None), (3, "one two three", "en", "s", 13, "x", "y", None), (3, "one two three", "en", "s", 13, "x", "y", None)]
    for given in (spark.createDataFrame(odd, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, FOLDER)
            out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == given.columns, name


def test_the_hot_leaf_pays_its_budget(spark):
    """The mix's totals stay within one document of each leaf's budget."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    total = sum(len(r.text.split()) for r in docs.collect())
    taken = sum(r.taken for r in queries_a.op1_mix_sources(spark, FOLDER).collect())
    assert taken == total
