import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logferry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "2"})


@pytest.fixture(scope="session")
def log(spark):
    """Make ``lines`` from JSON records of one session."""
    from pyspark.sql import functions as F

    def make(agent, records, session="s", project="p"):
        rows = [
            (project, session, agent, i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False))
            for i, r in enumerate(records)
        ]
        df = spark.createDataFrame(rows, "project_id string, session_id string, agent string, line_no bigint, raw string")
        return df.withColumn("v", F.try_parse_json("raw"))

    return make


@pytest.fixture(scope="session")
def sessions(spark):
    def make(agent="claude-code", root="/Users/me/proj", home="/Users/me", cwd=None, off=(), no_skills=False, session="s", project="p"):
        return spark.createDataFrame(
            [(project, session, agent, root, home, cwd or root, list(off), no_skills)],
            "project_id string, session_id string, agent string, root string, home string, cwd string, "
            "off array<string>, no_skills boolean",
        )

    return make


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a column expression over a list of texts."""

    def run(values, fn, schema="x string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
        return [r.r for r in df.select("i", fn(F.col("x")).alias("r")).orderBy("i").collect()]

    return run
