"""Reading project files and side inputs."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

FILES = "project_id string, path string, real_path string, is_file boolean, size bigint, content binary"


def read_project(spark: SparkSession, project_id: str, root: str) -> DataFrame:
    """Every regular file under ``root`` as a ``files`` row. The content column is only read where used."""
    return read_projects(spark, {project_id: root})


def read_projects(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Every regular file under the projects' roots, in one scan; links and what lies behind them are left out.

    A link shows by its real path, which only a local file system has; other stores hold no links.
    """
    places = sorted(((project, root.rstrip("/")) for project, root in roots.items()), key=lambda r: -len(r[1]))

    def straight(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        real = {root: os.path.realpath(root) for _, root in places}

        def one(path: str) -> bool:
            root = next((r for r in real if path.startswith(r + "/")), None)
            return root is None or os.path.realpath(path) == real[root] + path[len(root) :]

        for some in paths:
            yield some.map(one).astype(bool)

    path = F.regexp_replace(F.col("path"), "^file:(?://)?", "")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load([root for _, root in places])
        .withColumns({"named": path, "local": F.startswith("path", F.lit("file:"))})
    )
    project = F.coalesce(*[F.when(F.startswith("named", F.lit(root + "/")), F.lit(p)) for p, root in places])
    return files.where(~F.col("local") | F.pandas_udf(straight, "boolean")("named")).select(
        project.alias("project_id"), F.col("named").alias("path"), F.col("named").alias("real_path"),
        F.lit(True).alias("is_file"), F.col("length").alias("size"), "content",
    )


def ignore_listing(listing: DataFrame) -> DataFrame:
    """``project_id, repo, entry`` from one NUL-separated listing per repository (``project_id, repo, text``)."""
    return listing.select(
        "project_id", "repo", F.explode(F.filter(F.split("text", "\u0000", -1), lambda e: e != "")).alias("entry")
    )
