"""Queries of resampling, clustering and exact substrings; their results follow the stated contracts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, resample, substrings
from .registry import query, table


@query()
def op11_importance_resample(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = resample.fit(docs, table(spark, folder, "benchmark"))
    return resample.resample(docs, model).select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_rows(centroids.whole_numbers(table(spark, folder, "embeddings"), "embedding"))


def cluster_rows(vectors: DataFrame) -> DataFrame:
    """Each vector with its cluster, its distance, the inertia of its cluster and of all, and its centroid's digest."""
    made = centroids.cluster(vectors)
    own = dict(made.vectors.groupBy("cluster").agg(F.try_sum("distance")).collect())  # a row for each cluster; null beyond 64 bits
    every = sum(x or 0 for x in own.values())
    every = every if None not in own.values() and every < 1 << 63 else None
    facts = [(c, own.get(c), every, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(made.centroids.tolist())]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return made.vectors.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query()
def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeats(table(spark, folder, "documents"))
