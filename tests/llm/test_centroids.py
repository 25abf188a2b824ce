"""Clustering against plain Lloyd rounds in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from llm import centroids
from llm.queries_c import cluster_rows, op12_centroid_clusters

FIELDS = "vec_id bigint, embedding array<float>, v string, cluster string, key string"


def plain(rows, dim=64, k=16, rounds=3):
    """(vec_id, cluster, distance) of all kept rows, and the centroids."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centers = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (far(v, centers[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        centers = [[sum(x) // len(x) for x in zip(*groups[c])] if c in groups else old for c, old in enumerate(centers)]
    return [(i, (c := nearest(v)), far(v, centers[c])) for i, v in kept], centers


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, x or 0) for x in t))


def want(rows):
    got, centers = plain(rows)
    own = {c: sum(d for _, k, d in got if k == c) for _, c, _ in got}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, own[c], sum(own.values()), text[c]) for i, c, d in got), key=lambda t: tuple((x is None, x or 0) for x in t))


def vectors(n, seed, groups=7, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 64))
    return [(i, (middle[min(int(rng.geometric(0.35)), groups) - 1] + rng.normal(size=64) * spread).astype(np.float32).tolist()) for i in range(n)]


def test_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert rows_of(op12_centroid_clusters(spark, folder)) == want(rows)


def test_odd_rows_ties_and_repeats(spark):
    rows = vectors(150, 3)
    rows += [(None, rows[0][1]), (5, rows[9][1]), (5, rows[9][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65)]
    rows += [(904, [None] + [1.0] * 63), (905, [float("nan")] + [1.0] * 63), (906, [float("inf")] + [1.0] * 63), (907, [-0.001] * 64), (908, [20000.5] * 64)]
    rows += [(1000 + i, [0.0] * 64) for i in range(60)]  # a third of the rows are equal
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], FIELDS).repartition(3)
    assert rows_of(cluster_rows(centroids.whole_numbers(df, "embedding"))) == want(rows)


def test_only_expired_vectors_are_compared_again(spark):
    rows = vectors(400, 5, groups=5, spread=0.02)
    made = centroids.cluster(centroids.whole_numbers(spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], FIELDS), "embedding"), rounds=8)
    assert made.scanned[0] == 400 and all(n < 400 for n in made.scanned[1:])
    got, centers = plain(rows, rounds=8)
    assert rows_of(made.vectors) == sorted(got) and made.centroids.tolist() == centers


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_or_no_vectors(spark, n):
    rows = vectors(n, 1)
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], FIELDS)
    assert rows_of(cluster_rows(centroids.whole_numbers(df, "embedding"))) == want(rows)


def test_vectors_beyond_64_bits_are_left_out(spark):
    rows = [(1, [1e30] * 64), (2, [-1e15] * 64), (3, [2e6] * 64), (4, [0.5] * 64)]
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], FIELDS.replace("float", "double"))
    assert rows_of(cluster_rows(centroids.whole_numbers(df, "embedding")).select("vec_id", "distance")) == [(3, 0), (4, 0)]
