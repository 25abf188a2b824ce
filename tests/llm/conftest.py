"""Small helpers for the operators' tests."""

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of (doc_id, text) with columns whose names clash with those the operators make."""

    def make(rows, **more):
        fields = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n string, rep string"
        out = [(i, t, more.get("lang", "en"), more.get("source", "s0"), None if t is None else len(t), "x", "y", "z") for i, t in rows]
        return spark.createDataFrame(out, fields)

    return make
