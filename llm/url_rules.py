"""URL filters by a sort-merge range join, with DataFrame functions only.

A rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's. Its canonical key is the
host's labels reversed, a NUL, and the path; the keys it covers are the interval of strings that start with
it. Intervals of rules are nested or apart. A URL has a key for each suffix of its host.

Rules and URL keys are sorted together over ranges of keys. Sweeping a range, each rule start brings the stack of
rules active there (itself and the rules around it, outermost first); a URL key takes the stack of the last
start before it, carried over from earlier ranges where its own has none. Every rule around the key is in that
stack, so the innermost one that still covers the key is its rule. Of a URL's keys that of the longest host wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("\0"), path)


def stacks(rules: DataFrame) -> DataFrame:
    """key and ``stack``: the rules around each rule and itself, outermost first, as (start, rule, verdict)."""
    host = F.translate("host", UPPER, LOWER)
    one = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(labels(host).alias("labels"), host.alias("host"), "path", "verdict")
        .groupBy("labels", "host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("key", key(F.col("labels"), F.col("path")))
    )
    outer = one.select(F.col("key").alias("start"), F.concat("host", "path").alias("rule"), "verdict")
    inner = one.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: key(F.col("labels"), F.col("path").substr(F.lit(1), n)))).alias("start"))
    return inner.join(outer, "start").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rule", "verdict"))).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` as a struct ``row`` with host, path, rule and verdict.

    ``rules``: host, path, verdict; rows with a null are not read, hosts are lower-cased, and of equal (host, path)
    the greater verdict counts (block). A URL that no rule fits, null among them: rule null, verdict
    ``otherwise``. Rows stay as they are, repeated ones too; empty tables give empty results.
    """
    given = pages.select(F.struct("*").alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    levels = F.transform(F.sequence(F.lit(1), F.size(labels(F.col("host")))), lambda n: F.struct(n.alias("depth"), key(F.slice(labels(F.col("host")), 1, n), F.col("path")).alias("key")))
    asked = given.select("host", "path").distinct().select("host", "path", F.explode(levels).alias("k")).select("host", "path", "k.depth", "k.key", F.lit(1).alias("kind"))
    starts = stacks(rules).withColumn("kind", F.lit(0))
    events = asked.unionByName(starts, allowMissingColumns=True)
    # Sorted ranges; a rule's start comes before the keys it equals.
    dealt = stored(events.repartitionByRange("key", "kind", "host", "path").withColumn("part", F.spark_partition_id()), "url-ranges")
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    ends = dealt.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("end"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    carried = ends.select("part", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    active = swept.join(carried, "part").withColumn("active", F.coalesce("active", "carried"))
    fits = F.filter("active", lambda r: F.startswith(F.col("key"), r["start"]))
    found = (
        active.select("host", "path", "depth", F.try_element_at(fits, F.lit(-1)).alias("r")).where("r is not null")
        .groupBy("host", "path").agg(F.max_by("r", "depth").alias("r"))
    )
    return given.join(found, ["host", "path"], "left").select("row", "host", "path", "r.rule", F.coalesce("r.verdict", F.lit(otherwise)).alias("verdict"))
