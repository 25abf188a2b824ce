from pyspark.sql import Window, functions as F

from logferry.operators import ordered as O
from logferry.operators.relink import resolve_removed
from logferry.plans.corpus import redact_corpus
from logferry.streaming.feeds import findings_per_window, owners_feed, redact_feed


def test_chunked_passes_equal_plain_windows(spark):
    # One key holds most rows; chunks are far smaller than its history.
    df = spark.range(4000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        (F.col("id") * 3).alias("o"),
        F.when(F.col("id") % 11 == 0, F.col("id")).alias("x"),
    )
    w = Window.partitionBy("k").orderBy("o")
    plain = df.select(
        "k", "o",
        F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        (F.row_number().over(w) - 1).cast("bigint").alias("n"),
    )
    got = O.carry_forward(df, ["k"], "o", {"upto": F.col("x")}, chunk=97)
    got = O.carry_forward(got, ["k"], "o", {"before": F.col("x")}, before=True, chunk=101)
    got = O.number_rows(got, ["k"], "o", "n", chunk=500).select("k", "o", "upto", "before", "n")
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_long_chains_and_cycles_of_removed_lines(spark):
    chain = [("p", "s", f"u{i}", f"u{i - 1}" if i else "kept", i) for i in range(40)]
    ring = [("p", "s", "a", "b", 100), ("p", "s", "b", "c", 101), ("p", "s", "c", "a", 102), ("p", "s", "tail", "a", 103)]
    removed = spark.createDataFrame(chain + ring, "project_id string, session_id string, uuid string, parent string, line_no int")
    targets, stuck = resolve_removed(removed)
    got = {r.uuid: r.target for r in targets.collect()}
    assert all(got[f"u{i}"] == "kept" for i in range(40))
    assert all(got[u] is None for u in ("a", "b", "c", "tail"))
    assert {r.uuid for r in stuck.collect()} == {"a", "b", "c", "tail"}


def _run(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def test_feed_redaction_equals_the_table(spark, tmp_path):
    rows = [(i, f"row {i}\npassword = \"s3cretValue{i}\" mail a{i}@x.org" if i % 2 else f"plain {i}", f"2026-01-01 00:{i:02d}:00") for i in range(12)]
    table = spark.createDataFrame(rows, "id int, text string, at string").withColumn("at", F.to_timestamp("at"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    feed = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cols = ["id", "clean", "n_secrets", "n_emails"]
    _run(redact_feed(feed(), "text").select(*cols), "feed")
    want = redact_corpus(table, "text").select(*cols)
    got = spark.table("feed")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == 12
    _run(findings_per_window(feed(), "text", "at", late="1 hour"), "windows", "update")
    last = spark.table("windows").groupBy("start", "rule").agg(F.max("n").alias("n")).agg(F.sum("n")).collect()[0][0]
    assert last == 6


def test_calls_in_progress_across_batches(spark, tmp_path):
    rows = [
        ("s", 0, "item", None, None), ("s", 1, "call", "c1", "c1"), ("s", 2, "item", None, "c1"), ("s", 3, "output", "c1", "c1"),
        ("s", 4, "item", None, None), ("s", 5, "call", "c2", "c2"), ("s", 6, "item", None, "c2"), ("t", 7, "item", None, None),
    ]
    schema = "session string, line_no bigint, kind string, id string, want string"
    for i in range(0, 8, 2):
        spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feed = (
            spark.readStream.schema("session string, line_no bigint, kind string, id string, want string")
            .option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        )
        _run(owners_feed(feed.select("session", "line_no", "kind", "id")), "owners")
    finally:
        spark.conf.unset(provider)
    got = {r.line_no: r.owner for r in spark.table("owners").collect()}
    assert got == {r[1]: r[4] for r in rows}
