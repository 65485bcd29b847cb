"""Which events stand behind a burst or chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchspan.operators import slices
from watchspan.operators.correlation import Correlation, members, rule_list
from watchspan.session import stable_storage

# Members of one alert are numbered in this many parts first, so that no task sees all of a huge one.
PARTS = 64


def burst_members(matches: DataFrame, bursts: DataFrame, correlations: list[Correlation]) -> DataFrame:
    """Matches inside each burst: (rule, alert_id, step, at_us, member_rule, member_id).

    Bursts of one group never overlap, so a match belongs to at most one. Both sides meet on rule,
    group and time slice; a crowded slice on the match side is an equi-join skew that adaptive
    execution splits.
    """
    spans = rule_list(matches.sparkSession, [(c.name, c.span_us) for c in correlations],
                      "corr string, span_us bigint")
    taking_part = members(matches, correlations).join(spans, "corr").select(
        "corr", "grp", "ts_us", F.col("rule").alias("member_rule"), "match_id",
        slices.start_of(F.col("ts_us"), slices.width(F.col("span_us"))).alias("slice"))
    intervals = bursts.withColumnRenamed("rule", "corr").join(spans, "corr").select(
        "corr", "grp", "alert_id", "first_us", "last_us",
        F.explode(slices.covered(F.col("first_us"), F.col("last_us"), F.col("span_us")))
        .alias("slice"))
    return (taking_part.join(intervals, ["corr", "grp", "slice"])
            .filter(F.col("ts_us").between(F.col("first_us"), F.col("last_us")))
            .select(F.col("corr").alias("rule"), "alert_id", F.lit(0).alias("step"),
                    F.col("ts_us").alias("at_us"), "member_rule", F.col("match_id").alias("member_id")))


def chain_members(chains: DataFrame, correlations: list[Correlation]) -> DataFrame:
    rules = rule_list(chains.sparkSession, [(c.name, c.rules) for c in correlations],
                      "rule string, rules array<string>")
    return (chains.join(rules, "rule")
            .select("rule", "alert_id", "rules", F.posexplode("chain").alias("step", "link"))
            .select("rule", "alert_id", "step", F.col("link")["ts_us"].alias("at_us"),
                    F.get("rules", F.col("step")).alias("member_rule"),
                    F.col("link")["match_id"].alias("member_id")))


def events_behind(rows: DataFrame, alert_rules: list[str], inner: DataFrame | None) -> DataFrame:
    """Members that are events stay; members that are alerts are replaced by their own evidence.

    (rule, alert_id, event_id, step, at_us, member_id, ts_us); the last four say in which order the
    events of an alert come.
    """
    is_alert = F.col("member_rule").isin(alert_rules)
    own = (rows if inner is None else rows.filter(~is_alert)).select(
        "rule", "alert_id", F.col("member_id").alias("event_id"), "step", "at_us", "member_id",
        F.col("at_us").alias("ts_us"))
    if inner is None:
        return own
    nested = rows.filter(is_alert).join(
        inner.select(F.col("alert_id").alias("member_id"), "event_id", "ts_us"), "member_id")
    return own.unionByName(nested.select(*own.columns))


ORDER = ["step", "at_us", "member_id", "ts_us"]


def once_each(evidence: DataFrame) -> DataFrame:
    """The first occurrence of every event of an alert."""
    return (evidence.groupBy("rule", "alert_id", "event_id")
            .agg(F.min(F.struct(*ORDER)).alias("first"))
            .select("rule", "alert_id", "event_id", "first.*"))


def first_events(evidence: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` events per alert, numbered from 0 as ``pos``."""
    order = [*ORDER, "event_id"]
    part = F.pmod(F.xxhash64("event_id"), F.lit(PARTS))
    in_part = Window.partitionBy("alert_id", "part").orderBy(*order)
    in_alert = Window.partitionBy("alert_id").orderBy(*order)
    return (evidence.withColumn("part", part)
            .withColumn("rank", F.row_number().over(in_part)).filter(F.col("rank") <= limit)
            .withColumn("rank", F.row_number().over(in_alert)).filter(F.col("rank") <= limit)
            .withColumn("pos", F.col("rank") - 1).drop("part", "rank"))


def numbered(evidence: DataFrame) -> DataFrame:
    """All events per alert, numbered from 0 as ``pos``, however many an alert has.

    Rows are dealt by ranges of their order, so a huge alert spreads over as many tasks as others of its size do together. Inside a
    range places follow from the sort; what an alert has in earlier ranges is added from one row per alert and range.
    """
    order = ["alert_id", *ORDER, "event_id"]
    placed = stable_storage(evidence.repartitionByRange(*order).sortWithinPartitions(*order)
                            .withColumn("place", F.monotonically_increasing_id())
                            .withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy("alert_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (placed.groupBy("alert_id", "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("begin"))
              .select("alert_id", "range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("begin")).alias("shift")))
    return (placed.join(ranges, ["alert_id", "range"]).withColumn("pos", F.col("place") + F.col("shift"))
            .select(*evidence.columns, "pos"))


def union_all(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None
