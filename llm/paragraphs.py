"""Substring dedup: paragraphs that repeat, nearly or exactly, across and within documents.

A paragraph is a line of at least ``LEAST_WORDS`` words; its set is its distinct five-word shingles. Paragraphs with
equal sets are one class. MinHash bands bring classes together: of ``rows`` hashes a band, as many bands as
find a pair at the threshold with the wanted recall. Colliding classes are compared by the exact Jaccard
similarity of their sets; components of links are removed but for their first paragraph.

Beside paragraphs, passages that repeat word for word are found wherever they stand, also inside longer lines and across
line breaks: of every ``PASSAGE - GRAM + 1`` windows of ``GRAM`` words that follow each other, the one with the least
hash stands for them, so that two texts that share ``PASSAGE`` words choose the same one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _powers, buffers, components, distinct_by, mix, shingle_hashes, slices, stored, word_hashes, word_table
from .ngram_join import LIST_PAIRS, TABLE, bit_table, compare_blocks, groups_of, short_pairs, verified

SHINGLE, PERCENT, LEAST_WORDS = 5, 80, 5
ROWS, RECALL = 4, 0.999
#: Words of a passage that is found for certain, and of the windows it is found by: what is found has as many at least.
PASSAGE, GRAM = 50, 30


def bands(percent: int, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands that find a pair of just this similarity with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))


def _paragraphs(batch: pa.RecordBatch, k: int, least: int):
    """Of slices of a batch: rows' doc_id, line numbers, words, class ids, and (place, token) of the sets."""
    data, at = buffers(batch.column("text"))
    for i, j in slices(at):
        ends = at[i : j + 1]
        breaks = np.flatnonzero(data[ends[0] : ends[-1]] == 10) + ends[0] + 1
        lines = np.unique(np.concatenate([ends, breaks]))
        words, owner = word_hashes(data, lines)
        count = np.bincount(owner, minlength=len(lines))
        long = count[owner] >= least
        shingle, where = shingle_hashes(words[long], owner[long], len(lines), k)
        where, token = distinct_by(where, shingle)
        if not len(where):
            continue
        line, place, size = np.unique(where, return_inverse=True, return_counts=True)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        doc = np.searchsorted(ends, lines[line], "right") - 1
        number = line - np.searchsorted(lines, ends[doc], "left")
        name = np.add.reduceat(mix(token, 11), first)
        yield batch.column("doc_id").slice(i, j - i).take(pa.array(doc)), number, count[line], mix(name).view(np.int64), first, size, token


def _bands(token: np.ndarray, first: np.ndarray, rows: int, n: int) -> np.ndarray:
    """Band hashes (paragraph by band): each of the minima of ``rows`` permutations."""
    out = np.zeros((len(first), n), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(n):
            for r in range(rows):
                odd = mix(np.array([b * rows + r], np.uint64), 31)[0] | np.uint64(1)
                out[:, b] = out[:, b] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(token * odd), first)
            out[:, b] = mix(out[:, b], b)
    return out


def repeats(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, line, n_words, component, keep_doc, keep_line, removed: every paragraph that is like another.

    ``docs`` has doc_id and text; other columns are not read. ``line`` counts from 0. Of a component the
    paragraph with the smallest (doc_id, line) stays; a null doc_id comes first. Rows of one doc_id
    are one document: a repeated row adds nothing. Null, empty and short texts have no paragraph.
    """
    spark, texts, n_bands = docs.sparkSession, docs.select("doc_id", "text"), bands(percent)

    def sign(batches):
        for batch in batches:
            for doc, number, words, name, first, size, token in _paragraphs(batch, k, least):
                once = np.zeros(len(name), bool)  # a class's bands are written once a slice
                once[np.unique(name, return_index=True)[1]] = True
                at = pa.array(np.concatenate([[0], np.cumsum(once)]).astype(np.int32) * np.int32(n_bands))
                bits = _bands(token[np.repeat(once, size)], np.cumsum(size[once]) - size[once], ROWS, n_bands)
                signs = pa.ListArray.from_arrays(at, pa.array(bits.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([doc, pa.array(number, pa.int64()), pa.array(words, pa.int64()), pa.array(name), pa.array(size, pa.int64()), signs], ["doc_id", "line", "n_words", "class", "n", "bands"])

    seen = stored(texts.mapInArrow(sign, "doc_id long, line long, n_words long, class long, n long, bands array<long>"), "paragraphs")
    postings = seen.select(F.col("class").alias("rep"), "n", F.explode("bands").alias("token")).repartition("token")
    several = postings.groupBy("token").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").drop("last")
    size = F.count("*").over(Window.partitionBy("token")).alias("size")
    lists = stored(postings.join(several, "token").distinct().select("*", size), "collisions")
    pairs = stored(short_pairs(lists, percent), "pairs")
    groups = stored(groups_of(lists.where(F.col("size") > LIST_PAIRS)), "groups")
    alive = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(groups.select("doc_id")).distinct(), "alive")
    needed = spark.sparkContext.broadcast(bit_table(alive.select(F.pmod("doc_id", F.lit(TABLE)).alias("at"))))

    def sets_of(batches):
        for batch in batches:
            for _, _, _, name, first, size, token in _paragraphs(batch, k, least):
                at = name % TABLE
                name_at = np.flatnonzero((needed.value[at >> 6] >> (at & 63)) & 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[name_at]), pa.array(size[name_at], pa.int64()), pa.array([token[first[x] : first[x] + size[x]].tobytes() for x in name_at], pa.binary())], ["doc_id", "n", "tokens"]
                )

    sets = stored(texts.mapInArrow(sets_of, "doc_id long, n long, tokens binary").join(alive, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "sets")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"tokens_{x}"))
    links = verified(pairs.join(side("a"), "a").join(side("b"), "b"), percent).union(compare_blocks(groups.join(sets, "doc_id"), percent, []))
    root = components(links)

    where = seen.select("doc_id", "line", "n_words", "class").distinct()
    named = where.join(root, where["class"] == root.v, "left").select("doc_id", "line", "n_words", F.coalesce("root", "class").alias("component"))
    named = stored(named, "named")
    kept = named.groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "line")).alias("keep")).where("size > 1").select("component", "keep")
    return named.join(kept, "component").select(
        "doc_id", "line", "n_words", "component", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line"),
        (~F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) | (F.col("line") != F.col("keep.line"))).alias("removed"),
    )


def _slid(x: np.ndarray, w: int, least) -> np.ndarray:
    """The least (or largest) of each value and the w - 1 after it, as far as there are any."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.concatenate([least(out[:-step], out[step:]), out[-step:]]) if step < len(out) else least.accumulate(out[::-1])[::-1]
        have += step
    return out


def _chosen(batch: pa.RecordBatch, most: int, k: int):
    """Of slices of a batch: rows' doc_id, hashes, first words and lines of the chosen windows of ``k`` words."""
    data, at = buffers(batch.column("text"))
    w = most - k + 1
    for i, j in slices(at):
        ends = at[i : j + 1]
        words, owner, start, _ = word_table(data, ends)
        n = len(words) - k + 1
        if n < 1:
            continue
        up, down = _powers(len(words))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
            gram = mix((total[k:] - total[:-k]) * down[:n], k)
        place = np.flatnonzero(owner[:n] == owner[k - 1 :])
        if not len(place):
            continue
        gram, doc = gram[place], owner[place]
        # A window is chosen if it is the least of some w in a row of its text; a text with fewer has one such row.
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size = np.diff(np.append(first, len(doc)))
        inside = np.repeat(first + size, size) - np.arange(len(doc)) >= w
        least = np.where(inside, _slid(gram, w, np.minimum), np.uint64(0))
        chosen = _slid(least[::-1], w, np.maximum)[::-1] == gram
        few = size < w
        whole = np.repeat(few, size)
        chosen[whole] = (gram == np.repeat(np.minimum.reduceat(gram, first), size))[whole]
        pick = np.flatnonzero(chosen)
        at_word = place[pick]
        breaks = np.flatnonzero(data[ends[0] : ends[-1]] == 10) + ends[0]
        line = np.searchsorted(breaks, start[at_word]) - np.searchsorted(breaks, ends[doc[pick]])
        word = at_word - np.searchsorted(owner, doc[pick], "left")
        yield batch.column("doc_id").slice(i, j - i).take(pa.array(doc[pick])), gram[pick].view(np.int64), word, line


def passages(docs: DataFrame, most: int = PASSAGE, k: int = GRAM) -> DataFrame:
    """doc_id, line, n_words, component, keep_doc, keep_line, removed, word: passages that occur more than once.

    Every run of ``most`` words (A-Z lower-cased) that occurs at two places, in one document or two, has a row at
    both; a row's words are all repeated. It may begin and end up to ``most - k`` words inside the run, and shorter
    runs, of ``k`` words at least, may be found as well. ``word`` is the first word's number in the text, ``line`` its
    line. Each window is kept where the smallest (doc_id, word) has it; of a document, neighbouring windows make one
    passage of kept or of removed words, and keep_doc and keep_line are those of its first window. Rows of one
    doc_id are one document.
    """
    spark, texts = docs.sparkSession, docs.select("doc_id", "text")

    def count(batches):
        for batch in batches:
            for _, gram, _, _ in _chosen(batch, most, k):
                yield pa.RecordBatch.from_arrays([pa.array(gram)], ["gram"])

    several = stored(texts.mapInArrow(count, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    needed = spark.sparkContext.broadcast(bit_table(several.select(F.pmod("gram", F.lit(TABLE)).alias("at"))))

    def held(batches):
        for batch in batches:
            for doc, gram, word, line in _chosen(batch, most, k):
                at = gram % TABLE
                x = np.flatnonzero((needed.value[at >> 6] >> (at & 63)) & 1)
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(x)), pa.array(gram[x]), pa.array(word[x], pa.int64()), pa.array(line[x], pa.int64())], ["doc_id", "gram", "word", "line"])

    found = texts.mapInArrow(held, "doc_id long, gram long, word long, line long").join(several, "gram", "left_semi")
    found = stored(found.distinct(), "held")
    ends = found.groupBy("gram").agg(F.min(F.struct("doc_id", "word", "line")).alias("keep"), F.max(F.struct("doc_id", "word", "line")).alias("last"))
    ends = ends.where(~F.col("keep").eqNullSafe(F.col("last"))).drop("last")
    here = F.struct("doc_id", "word", "line")
    marked = found.join(ends, "gram").withColumn("removed", ~here.eqNullSafe(F.col("keep")))
    along = Window.partitionBy("doc_id", "removed").orderBy("word")
    begins = F.coalesce(F.col("word") - F.lag("word").over(along) > k, F.lit(True)).cast("long")
    runs = marked.withColumn("begins", begins).withColumn("run", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("word", "line", "gram", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line"))).alias("f")
    return runs.groupBy("doc_id", "removed", "run").agg(first, (F.max("word") - F.min("word") + k).alias("n_words")).select(
        "doc_id", "f.line", "n_words", F.col("f.gram").alias("component"), "f.keep_doc", "f.keep_line", "removed", "f.word"
    )


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the removed paragraphs taken out of ``text``; all rows and columns stay."""
    gone = repeats(docs, **settings).where("removed").groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))
    at = docs.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id").eqNullSafe(gone.doc_id), "left")
    lines = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains(F.col("_gone"), i.cast("long")))
    text = F.when(F.col("_gone").isNull(), F.col("row.text")).otherwise(F.array_join(lines, "\n"))
    return at.select(F.col("row").withField("text", text).alias("row")).select("row.*").select(*docs.columns)
