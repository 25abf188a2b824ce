"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.neutral import neutral_json
from ..operators.touches import KEYS

FILE_LINES = 1_000_000


def write_lines(lines: DataFrame, path: str, order: str = "line_no", text: str = "raw", folders: list[str] = KEYS) -> None:
    """JSON lines in order, in one folder per session.

    Rows are spread by session and line range, so a very long session is written by many tasks;
    its files sort by name into the session's order because their ranges do.
    """
    rows = lines.withColumn("part", F.floor(F.col(order) / FILE_LINES))
    (
        rows.repartition(*folders, "part")
        .sortWithinPartitions(*folders, "part", order)
        .select(*folders, "part", F.col(text).alias("value"))
        .write.mode("overwrite")
        .partitionBy(*folders, "part")
        .text(path)
    )


def write_neutral(neutral: DataFrame, path: str) -> None:
    """The neutral conversation as JSON lines."""
    from ..operators.ordered import SEQ_CHUNK, number_rows

    write_lines(number_rows(neutral_json(neutral), KEYS, "seq", "line_no", SEQ_CHUNK), path, text="json")


def write_manifests(manifests: DataFrame, path: str) -> None:
    """One manifest record per session."""
    manifests.write.mode("overwrite").partitionBy("project_id").option("ignoreNullFields", "false").json(path)


def write_received(received: DataFrame, path: str) -> None:
    """What arrived, one ``{"files": [...]}`` per bundle (S13): what ``bundles.received_files`` reads."""
    lists = received.groupBy("bundle_id").agg(F.sort_array(F.collect_set("rel")).alias("files"))
    lists.write.mode("overwrite").partitionBy("bundle_id").json(path)


def write_installed(logs: DataFrame, path: str) -> None:
    """Rebuilt logs by the folders each agent looks in: ``place`` comes from ``install_folder``.

    Every step of a place (a log by date: top, year, month, day, file) is a folder level of its own.
    """
    steps = F.split("place", "/")
    names = [f"level_{i}" for i in range(1, 6)]
    levels = {n: F.coalesce(F.get(steps, F.lit(i)), F.lit("-")) for i, n in enumerate(names)}
    write_lines(logs.withColumns(levels), path, folders=["agent", *names])
