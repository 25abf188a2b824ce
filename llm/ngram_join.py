"""Exact n-gram Jaccard join by parts of the token space and prefix filters under several global token orders.

A text's set is its distinct k-word shingles. Two sets with Jaccard >= t differ in few tokens, so of more parts than
that, into which the token space is cut, one holds the same tokens in both; a part's tokens are one key. A key stands
for some eight tokens at once: unlike texts do not meet in it, however large the table and however frequent their
tokens. Such sets also share a token among their first ``n - ceil(t n) + 1`` tokens under *every* total order of
tokens, so a pair is verified only if it passes under all ``ORDERS`` orders. Each order puts frequent tokens last (by a
count over all texts) and the others by an order of its own.

Texts with equal sets are one class and are compared once. Lists of up to ``LIST_PAIRS`` classes give their
pairs, of which a bitmap of each set's token parities, whose differing bits bound the sets' difference from
below, rules out most before the orders and the sets are looked at. Of longer lists only what they connect is wanted:
each class is compared with one class of a list, and lists whose classes are all connected then are done. What is left
is compared by bitmaps inside tasks, in blocks, but for classes that are connected already; in the first turns a block
gives only pairs that would connect its components, at last all that its bitmaps allow. No pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, components, distinct_by, mix, shingle_hashes, slices, stored, tidy, word_hashes

ORDERS = 3
#: A list of up to so many classes gives its pairs one by one; longer ones go by blocks.
LIST_PAIRS = 8
#: Turns in which a block gives only the pairs that would connect its components.
TURNS = 2
#: Classes in a side of a block of sets, and of bitmaps.
BLOCK, BITMAPS = 256, 2048
#: The most frequent tokens that are broadcast (8 bytes each).
FREQUENT = 1 << 20
#: Bits of a set's parity bitmap, and of the table that tells texts no candidate needs.
SKETCH, TABLE = 2048, 1 << 25
#: Bytes of text whose sets are made at a time inside a task; their arrays take some 40 times as much.
PART = 1 << 19


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, index within the slice, token): distinct tokens of slices of a batch."""
    data, at = buffers(batch.column("text"))
    for i, j in slices(at, PART):
        words, owner = word_hashes(data, at[i : j + 1])
        owner, token = distinct_by(*reversed(shingle_hashes(words, owner, j - i, k)))
        yield i, j - i, owner, token


def _packed(token: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted 32-bit tokens as byte planes of their differences, and (place, count) where the count isn't 1."""
    step = np.diff(token, prepend=np.uint32(0)).astype("<u4")
    more = np.flatnonzero(n > 1)
    return step.view(np.uint8).reshape(-1, 4).T.tobytes(), np.stack([more, n[more]]).astype("<u4").tobytes()


def _unpacked(planes: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    step = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    token, n = np.cumsum(step, dtype=np.uint32), np.ones(len(step), np.int64)
    place, count = np.frombuffer(more, "<u4").reshape(2, -1)
    n[place] = count
    return token, n


def _size_of(df: DataFrame) -> int:
    """The planner's estimate of a table's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def frequent_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted tokens, cut to 32 bits, held by more than LIST_PAIRS texts, with their counts.

    Counts every token of every text. A task sorts and sums its tokens and sends them packed (about two bytes a
    token) to as many ranges as the table's size asks for, so no range grows with the table. Of the frequent
    ones the FREQUENT most frequent are kept: a fixed bound on what is broadcast. Which tokens are
    in it affects speed only, never the result.
    """
    ranges = 1 << max(6, min(20, (_size_of(docs) >> 23).bit_length()))
    shift = np.uint32(32 - (ranges.bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def rows():
            token, n = np.unique(np.concatenate(waiting), return_counts=True)
            ends = np.flatnonzero(np.diff(token >> shift, append=np.uint32(ranges))) + 1
            starts = np.concatenate([[0], ends])[:-1]
            packed = [_packed(token[i:j], n[i:j]) for i, j in zip(starts, ends)]
            return pa.RecordBatch.from_arrays(
                [pa.array(token[starts] >> shift, pa.int32()), *(pa.array([x[c] for x in packed], pa.binary()) for c in (0, 1))], ["range", "planes", "more"]
            )

        for batch in batches:
            for _, _, _, got in _sets(batch, k):
                waiting.append((got >> np.uint64(32)).astype(np.uint32))
                size += len(got)
                if size > 1 << 22:
                    yield rows()
                    waiting, size = [], 0
        if size:
            yield rows()

    def merge(key, table):
        both = [_unpacked(a.as_py(), b.as_py()) for a, b in zip(table["planes"], table["more"])]
        token, where = np.unique(np.concatenate([x for x, _ in both]), return_inverse=True)
        n = np.bincount(where, np.concatenate([x for _, x in both])).astype(np.int64)
        many = n > LIST_PAIRS
        return pa.table({"token": pa.array(token[many], pa.int64()), "n": pa.array(n[many])})

    rows = (
        docs.select("text").mapInArrow(tidy(count), "range int, planes binary, more binary")
        .groupBy("range").applyInArrow(merge, "token long, n long").orderBy(F.desc("n"), "token").limit(FREQUENT)
    )
    got = rows.toArrow()
    token, n = got["token"].to_numpy().astype(np.uint32), got["n"].to_numpy()
    order = np.argsort(token)
    return np.rec.fromarrays([token[order], np.minimum(n[order], 0x7FFFFFFF).astype(np.int32)], names="token,n")


def _rank(token: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """0 for a token that isn't frequent, else its count."""
    if not len(frequent):
        return np.zeros(len(token), np.int32)
    cut = (token >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(frequent["token"], cut), len(frequent) - 1)
    return np.where(frequent["token"][at] == cut, frequent["n"][at], 0)


def _prefixes(owner, token, n, frequent, percent, order) -> tuple[np.ndarray, np.ndarray]:
    """(owner, token) of the first n - ceil(percent n / 100) + 1 tokens of each text under an order."""
    by = np.lexsort((mix(token, 101 + order), _rank(token, frequent), owner))
    owner, token = owner[by], token[by]
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = np.arange(len(owner)) - first[owner]
    keep = place <= n[owner] - (percent * n[owner] + 99) // 100
    return owner[keep], token[keep]


def _lists(owner: np.ndarray, token: np.ndarray, n: int) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(token.view(np.int64)))


@cache
def size_bands(most: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, parts and spare parts of the bands of set sizes up to ``most``.

    Of two similar sets the smaller one's band has both or the larger one is in the next. They differ in fewer tokens than the
    band has parts without the spare ones, so that more than the spare parts hold the same tokens in both. 0 parts: only equal sets are similar.
    """
    rows, low = [], 1
    while low <= most:
        high = max(low, low * 10_000 // percent**2)
        differ = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        spare = differ // 20 + 1 if differ >= 5 else 0
        rows.append((low, differ + 1 + spare if differ else 0, spare))
        low = high + 1
    return tuple(np.array(x, np.int64) for x in zip(*rows))


def _parts(owner: np.ndarray, token: np.ndarray, n: np.ndarray, percent: int) -> pa.ListArray:
    """Each text's keys: the hashes of its tokens in the parts of its size's band, and of the band before if a similar set can be there.

    Parts with fewer than two tokens, in which unlike texts could meet, are left out if there are no more of them
    than spare parts: then two similar sets still have an equal part that both give.
    """
    low, parts, spare = size_bands(1 << max(0, int(n.max(initial=1)) - 1).bit_length(), percent)
    own, keys, whose = np.searchsorted(low, n, "right") - 1, [], []
    for back in range(2):
        band = np.maximum(own - back, 0)
        count = np.where((own >= back) & ((back == 0) | ((low[own] - 1) * 100 // percent >= n)), parts[band], 0)
        first = np.concatenate([[0], np.cumsum(count)])
        mine = count[owner] > 0
        who, held = owner[mine], token[mine]
        at = first[who] + (((mix(held, 55) >> np.uint64(32)) * count[who].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(first[-1], np.uint64)
        np.add.at(total, at, mix(held, 33))
        text = np.repeat(np.arange(len(n)), count)
        number = np.arange(first[-1]) - first[text]
        light = np.bincount(at, minlength=first[-1]) < 2
        keep = ~(light & (np.bincount(text[light], minlength=len(n)) <= spare[band])[text])
        keys.append(mix(total + mix((band[text] << 32 | number).astype(np.uint64), 91))[keep])
        whose.append(text[keep])
    whose = np.concatenate(whose)
    by = np.argsort(whose, kind="stable")
    return _lists(whose[by], np.concatenate(keys)[by], len(n))


def _sketch(owner: np.ndarray, token: np.ndarray, n: int) -> pa.ListArray:
    """Each set's bitmap: bit b is the parity of the number of its tokens that hash to b. Differing bits <= differing tokens."""
    place, count = np.unique(owner * SKETCH + (mix(token, 77) >> np.uint64(64 - (SKETCH.bit_length() - 1))).astype(np.int64), return_counts=True)
    place = place[count % 2 == 1]
    bits = np.bincount(place >> 3, np.left_shift(1, place & 7), n * SKETCH // 8).astype(np.uint8).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(bits))


def bit_table(places: DataFrame) -> np.ndarray:
    """A bit table of fixed size with the bits at places (at, below TABLE): what lacks its bit is not among them."""
    rows = places.select("at").groupBy(F.expr("at div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(TABLE // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 |a and b| >= percent |a or b| for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def similar_classes(docs: DataFrame, k: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(members, links): every text's class, and links between class representatives.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. members: doc_id, rep (the smallest
    doc_id with an equal set; null for an empty set), n_shingles. links (a, b), a < b: pairs with
    100 |A and B| >= percent |A or B|; of groups that are compared in blocks, a set of links with the same
    reachability. A null or empty text has the empty set and links with nothing; rows with a null doc_id
    are kept as members but can represent no class. Repeated rows join the same class. Empty tables give
    empty results.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(frequent_tokens(texts, k))

    def keyed(batches):
        for batch in batches:
            for i, m, owner, token in _sets(batch, k):
                n = np.bincount(owner, minlength=m)
                key = np.zeros((m, 2), np.uint64)
                at = np.concatenate([[0], np.cumsum(n)])
                some = np.flatnonzero(n)
                for c in range(2) if len(some) else ():
                    key[some, c] = np.add.reduceat(mix(token, 11 + c), at[some])
                keys = [key[x].tobytes() if n[x] else None for x in range(m)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, m), pa.array(n), pa.array(keys, pa.binary()), pa.array(key[:, 0].view(np.int64)), _parts(owner, token, n, percent), _sketch(owner, token, m)],
                    ["doc_id", "n", "key", "class", "parts", "sketch"],
                )

    seen = stored(texts.mapInArrow(tidy(keyed), "doc_id long, n long, key binary, class long, parts array<long>, sketch array<long>"), "sets")
    named = seen.where("key is not null and doc_id is not null")
    classes = stored(named.groupBy("class", "key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    members = stored(
        seen.select("doc_id", "n", "key").join(classes.select("key", "rep"), "key", "left").select("doc_id", "rep", F.col("n").alias("n_shingles")), "members"
    )
    # A list is kept if it holds several classes; ``class`` is half a key, and classes that share it come back as two.
    alike = Window.partitionBy("token")
    several = named.select("class", F.explode("parts").alias("token")).select("*", F.min("class").over(alike).alias("least"), F.max("class").over(alike).alias("last"))
    several = stored(several.where("least < last").select("token", "class").distinct(), "several")
    facts = stored(classes.join(several.select("class").distinct(), "class", "left_semi").select("class", "rep", "n", "sketch"), "facts")
    lists = stored(several.join(facts.select("class", "rep", "n"), "class").select("token", "rep", "n", F.count("*").over(alike).alias("size")), "lists")

    bit_a, bit_b = (facts.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)

    def like(pairs):
        return pairs.join(bit_a, "a").join(bit_b, "b").where(differ * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b").distinct()

    pairs = stored(like(short_pairs(lists, percent)), "pairs")
    long = lists.where(F.col("size") > LIST_PAIRS).select("token", "rep")

    alive = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(long.select("rep")).distinct(), "alive")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(TABLE)).alias("at")
    needed = spark.sparkContext.broadcast(bit_table(alive.select(at)))

    def all_orders(batches):
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((needed.value[at >> 6] >> (at & 63)) & 1 == 1))
            for i, m, owner, token in _sets(batch, k):
                n = np.bincount(owner, minlength=m)
                at = np.concatenate([[0], np.cumsum(n)])
                first = [_lists(*_prefixes(owner, token, n, shared.value, percent, o), m) for o in range(ORDERS)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, m), *first, pa.array([token[at[x] : at[x + 1]].tobytes() for x in range(m)], pa.binary())],
                    ["doc_id", *orders, "tokens"],
                )

    orders = [f"p{o}" for o in range(ORDERS)]
    sets = texts.where("doc_id is not null").select("doc_id", "text", at)
    sets = sets.mapInArrow(tidy(all_orders), f"doc_id long, {', '.join(f'{p} array<long>' for p in orders)}, tokens binary")
    sets = stored(sets.join(alive, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "alive-sets")

    def side(name, *columns):
        return sets.select(F.col("doc_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    def similar(pairs):
        """The orders' filters on narrow rows, then the sets of those that are left."""
        passed = pairs.join(side("a", *orders), "a").join(side("b", *orders), "b")
        for p in orders:
            passed = passed.where(F.arrays_overlap(f"{p}_a", f"{p}_b"))
        return verified(passed.select("a", "b").join(side("a", "tokens"), "a").join(side("b", "tokens"), "b"), percent)

    links = stored(similar(stored(pairs.union(like(one_each(long))).distinct(), "pairs")), "links")
    return members, connected(long, links, facts, percent, similar)


def one_each(lists: DataFrame) -> DataFrame:
    """(a, b), a < b: a pair for each class of lists (token, rep), with the first class of a list in one order of all: few stand for many lists."""
    by = F.struct(F.xxhash64("rep").alias("place"), "rep")
    heads = lists.groupBy("token").agg(F.min(by)["rep"].alias("head"))
    pairs = lists.join(heads, "token").where("rep <> head").groupBy("rep").agg(F.min("head").alias("head"))
    return pairs.select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b"))


def connected(lists: DataFrame, links: DataFrame, facts: DataFrame, percent: int, similar: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The links, and others that connect what similar classes of the lists (token, rep) connect.

    ``similar`` gives those of the pairs (a, b) that are similar. Bitmaps are close to the sets' difference, so most pairs that
    would connect components do, and in the last turn few components with pairs to compare are left.
    """
    if not lists.limit(1).count():
        return links
    root = components(links)
    now = lists.join(root, lists.rep == root.v, "left").select("token", "rep", F.coalesce("root", "rep").alias("component"))
    several = now.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("rep").alias("pivot")).where("x < y")
    now = stored(now.join(several.select("token", "pivot"), "token"), "unconnected")
    if not now.limit(1).count():
        return links
    group = components(now.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    rows = stored(group.select(F.col("v").alias("rep"), F.col("root").alias("grp")).join(facts.select("rep", "n", "sketch"), "rep"), "groups")
    for turn in range(TURNS + 1):
        at = rows.join(components(links) if turn else root, F.col("rep") == F.col("v"), "left").withColumn("component", F.coalesce("root", "rep")).drop("v", "root")
        pairs = stored(across(at, percent, turn < TURNS), "pairs")
        if not pairs.limit(1).count():
            return links
        links = stored(links.union(similar(pairs)), "links")
    return links


def across(rows: DataFrame, percent: int, connecting: bool) -> DataFrame:
    """(a, b), a < b: pairs of a group's classes of different components whose bitmaps allow similar sets; if ``connecting``, of each block those that would connect it.

    ``rows`` has rep, grp, component, n and sketch. A group's largest component is compared with the others only, which are
    compared with each other as well; what is dealt out to blocks are bitmaps, BITMAPS a side.
    """
    sizes = rows.groupBy("grp", "component").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("grp").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("size"))
    sides = lambda n: F.ceil(n / BITMAPS)
    sizes = sizes.select("grp", F.col("most.component").alias("most"), sides(F.col("size") - F.col("most.size")).alias("few"), sides(F.col("most.size")).alias("many"))
    place, few, many = F.xxhash64("rep"), F.col("few"), F.col("many")
    rows = rows.join(sizes.where("few > 0"), "grp").withColumn("side", F.when(F.col("component") == F.col("most"), few + F.pmod(place, many)).otherwise(F.pmod(place, few)))
    low = rows.where("side < few").select("*", F.explode(F.sequence("side", few + many - 1)).alias("other")).select(
        "*", F.col("side").alias("s1"), F.col("other").alias("s2"), F.lit(0).alias("part")
    )
    high = rows.where("side > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least("side", "few") - 1)).alias("other")).select(
        "*", F.col("other").alias("s1"), F.col("side").alias("s2"), F.lit(1).alias("part")
    )

    def compare(key, table):
        part = table["part"].to_numpy()
        ids, n = table["rep"].to_numpy(), table["n"].to_numpy()
        comp = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
        bits = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        first = np.flatnonzero(part == 0)
        second = first if key[1].as_py() == key[2].as_py() else np.flatnonzero(part == 1)
        found = [np.zeros((2, 0), np.int64)]
        for i in range(0, len(first), 64):
            x, y = first[i : i + 64, None], second[None, :]
            differ = sum(np.bitwise_count(bits[x, w] ^ bits[y, w]).astype(np.int64) for w in range(bits.shape[1]))
            spare = (100 - percent) * (n[x] + n[y]) - differ * (100 + percent)
            at, to = np.nonzero((comp[x] != comp[y]) & (spare >= 0) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])))
            x, y = first[i + at], second[to]
            if connecting:
                kept = []
                for p in np.argsort(-spare[at, to] / (n[x] + n[y])):
                    a, b = comp[x[p]], comp[y[p]]
                    if a != b:
                        kept.append(p)
                        comp[comp == max(a, b)] = min(a, b)
                x, y = x[kept], y[kept]
            found.append(np.stack([ids[x], ids[y]]))
        pairs = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    blocks = low.union(high).select("grp", "s1", "s2", "part", "rep", "component", "n", "sketch").groupBy("grp", "s1", "s2")
    return blocks.applyInArrow(compare, "a long, b long").distinct()


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of classes of similar sizes in the short ones of lists (token, rep, n, size)."""
    near = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    return (
        lists.where(F.col("size") <= LIST_PAIRS)
        .groupBy("token").agg(F.array_sort(F.collect_list(F.struct("rep", "n"))).alias("m"))
        .select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
        .where(near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).where("a <> b").distinct()
    )


def verified(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, tokens_a, tokens_b) whose sets are similar, as (a, b)."""

    def verify(batches):
        for batch in batches:
            a, b = batch.column("tokens_a"), batch.column("tokens_b")
            ok = [_enough(_ints(a[x].as_buffer()), _ints(b[x].as_buffer()), percent) for x in range(len(a))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "tokens_a", "tokens_b").mapInArrow(tidy(verify), "a long, b long")


def groups_of(long: DataFrame) -> DataFrame:
    """(doc_id, grp, side, sides): classes that long lists connect, and their place among the group's sides.

    Two classes that share a token of a long list are in one group, so comparing a group's sides with each other
    misses no pair of its lists. A group's sides have about BLOCK classes each.
    """
    root = components(long.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    sizes = root.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("sides"))
    return root.join(sizes, "root").select(
        F.col("v").alias("doc_id"), F.col("root").alias("grp"), F.pmod(F.xxhash64("v"), "sides").alias("side"), "sides"
    )


def compare_blocks(rows: DataFrame, percent: int, orders: list[str]) -> DataFrame:
    """Links found by comparing all sides of each group, block by block."""

    def compare(key, frame):
        first = frame[frame.part == 0].reset_index(drop=True)
        second = frame[frame.part == 1].reset_index(drop=True) if (frame.part == 1).any() else None
        return _compare_block(first, second, percent, orders)

    low = rows.select("*", F.explode(F.sequence("side", F.col("sides") - 1)).alias("other")).select(
        "*", F.col("side").alias("s1"), F.col("other").alias("s2"), F.lit(0).alias("part")
    )
    high = rows.where("side > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)).alias("other")).select(
        "*", F.col("other").alias("s1"), F.col("side").alias("s2"), F.lit(1).alias("part")
    )
    return low.union(high).select("grp", "s1", "s2", "part", "doc_id", "n", *orders, "tokens").groupBy("grp", "s1", "s2").applyInPandas(compare, "a long, b long")


def _matrix(columns, index, size):
    """A 0/1 matrix, a row for each list, over the tokens in ``index``."""
    out = np.zeros((len(columns), size), np.float32)
    for r, x in enumerate(columns):
        out[r, np.searchsorted(index, x)] = 1
    return out


def _compare_block(first, second, percent, orders):
    import pandas as pd

    whole = [first] if second is None else [first, second]
    ids = np.concatenate([f.doc_id.to_numpy() for f in whole])
    sets = [np.frombuffer(x, np.uint64) for f in whole for x in f.tokens]
    n = np.array([len(x) for x in sets])
    m = len(first)
    rows, cols = np.arange(m), np.arange(len(ids)) if second is None else np.arange(m, len(ids))
    ok = 100 * np.minimum.outer(n[rows], n[cols]) >= percent * np.maximum.outer(n[rows], n[cols])
    for o in orders:  # a common token in the prefix under each order
        lists = [np.asarray(x) for f in whole for x in f[o]]
        ok &= _common(lists, rows, cols) > 0
    if second is None:
        ok &= np.tri(m, m, -1, bool)
    if ok.any():
        used_r, used_c = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        both = _common(sets, rows[used_r], cols[used_c])
        union = n[rows[used_r]][:, None] + n[cols[used_c]][None, :] - both
        ok[np.ix_(used_r, used_c)] &= 100 * both >= percent * union
    x, y = np.nonzero(ok)
    # links that connect what the block connects
    parent: dict[int, int] = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    kept = []
    for i, j in zip(rows[x], cols[y]):
        a, b = find(int(i)), find(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pd.DataFrame(kept, columns=["a", "b"]).astype("int64")


def _common(lists, rows, cols) -> np.ndarray:
    """|x and y| for all x in rows, y in cols: products of 0/1 matrices over bounded runs of the shared tokens."""
    tokens, seen = np.unique(np.concatenate([lists[i] for i in np.union1d(rows, cols)]), return_counts=True)
    tokens = tokens[seen > 1]
    out = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(tokens), 8192):
        part = tokens[at : at + 8192]
        a, b = (_part(lists, side, part) for side in (rows, cols))
        out += a @ b.T
    return out.astype(np.int64)


def _part(lists, side, tokens) -> np.ndarray:
    out = np.zeros((len(side), len(tokens)), np.float32)
    for r, i in enumerate(side):
        at = np.searchsorted(tokens, lists[i])
        at[at == len(tokens)] = 0
        out[r, at[tokens[at] == lists[i]]] = 1
    return out


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach; a text without a set stands alone."""
    members, links = similar_classes(docs, k, percent)
    root = components(links)
    return members.join(root, members.rep == root.v, "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row(s) with its smallest doc_id, once.

    Texts with an empty set and rows without an id are linked with nothing and stay.
    """
    drop = jaccard_components(docs, k, percent).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(drop, docs.doc_id == drop["_gone"], "left_anti")
