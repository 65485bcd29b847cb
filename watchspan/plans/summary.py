"""Figures over events and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.functions.fields import present
from watchspan.rules import Rule, rules_table
from watchspan.schema import LEVELS, iso_seconds, level_name
from watchspan.session import local_table, stable_storage

HOUR, DAY = 3600, 86400
HOURLY_UP_TO = 3 * DAY
TOP_ENTITIES = 8


def events_by_source(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("events"))


def events_range(events: DataFrame) -> DataFrame:
    return events.agg(iso_seconds(F.min("ts")).alias("first"), iso_seconds(F.max("ts")).alias("last"),
                      F.count(F.lit(1)).alias("events"))


def alerts_by_level(alerts: DataFrame) -> DataFrame:
    """All five levels, worst first, with 0 where there are no alerts."""
    levels = local_table(alerts.sparkSession, list(enumerate(LEVELS)), "level_rank int, level string")
    counts = alerts.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return (levels.join(counts, "level", "left")
            .select("level", F.coalesce("n", F.lit(0)).alias("alerts"), "level_rank")
            .orderBy(F.desc("level_rank")).drop("level_rank"))


def alerts_by_rule(alerts: DataFrame) -> DataFrame:
    return (alerts.groupBy("rule").agg(F.count(F.lit(1)).alias("alerts"))
            .orderBy(F.desc("alerts"), "rule"))


def top_entities(alerts: DataFrame, limit: int = TOP_ENTITIES) -> DataFrame:
    """Group values by their worst alert, then by number of alerts."""
    return (alerts.select(F.explode(F.map_values("grp")).alias("entity"), "level_rank")
            .filter(present(F.col("entity")).isNotNull())
            .groupBy("entity").agg(F.count(F.lit(1)).alias("alerts"), F.max("level_rank").alias("worst_rank"))
            .orderBy(F.desc("worst_rank"), F.desc("alerts"), "entity").limit(limit)
            .select("entity", "alerts", level_name(F.col("worst_rank")).alias("worst")))


def _floor(seconds: Column, size: Column) -> Column:
    return seconds - F.pmod(seconds, size)


def timeline(alerts: DataFrame) -> DataFrame:
    """Alerts per level over time: hourly for a range of up to three days, else daily.

    Buckets are aligned to the epoch, and empty ones are there too. Alerts are counted per hour once; the rest works
    on hours, of which there are few.
    """
    hours = stable_storage(alerts.groupBy(_floor(F.unix_seconds("ts_first"), F.lit(HOUR)).alias("hour")).agg(
        F.min("ts_first").alias("earliest"), F.max("ts_first").alias("latest"),
        *[F.count_if(F.col("level") == name).alias(name) for name in LEVELS]))
    length = F.unix_micros(F.max("latest")) - F.unix_micros(F.min("earliest"))
    size = F.when(length <= HOURLY_UP_TO * 1_000_000, HOUR).otherwise(DAY).cast("bigint")
    bounds = hours.agg(F.min("hour").alias("begin"), F.max("hour").alias("end"), size.alias("size"))
    steps = F.sequence(_floor(F.col("begin"), F.col("size")), F.col("end"), F.col("size"))
    spine = bounds.select(F.explode(steps).alias("bucket"), "size")
    counts = (hours.groupBy(_floor(F.col("hour"), bounds.select("size").scalar()).alias("bucket"))
              .agg(*[F.sum(name).alias(name) for name in LEVELS]))
    return (spine.join(counts, "bucket", "left")
            .select(iso_seconds(F.timestamp_seconds("bucket")).alias("t"),
                    F.col("size").alias("bucket_seconds"),
                    *[F.coalesce(name, F.lit(0)).alias(name) for name in LEVELS])
            .orderBy("t"))


def rules_with_counts(spark: SparkSession, rules: list[Rule], alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return (rules_table(spark, rules).join(counts, "rule", "left")
            .select("position", "rule", "title", "level", "description", "tags", "kind",
                    F.coalesce("n", F.lit(0)).alias("alerts")).orderBy("position"))


def rule_list(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Name, level, kind, tags, and whether the rule makes alerts of its own."""
    return rules_table(spark, rules).select(
        "rule", "level", "kind", F.when(F.col("silenced"), "no").otherwise("yes").alias("alerts"),
        F.array_join("tags", ", ").alias("tags"))


def pretty_tag(tag: Column) -> Column:
    bare = F.regexp_replace(tag, r"\Aattack\.", "")
    return F.when(bare.startswith("t1"), F.upper(bare)).otherwise(F.replace(bare, F.lit("_"), F.lit(" ")))


def rule_catalogue(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """By folder, worst level first, then name."""
    return (rules_table(spark, rules)
            .orderBy("folder", F.desc("level_rank"), "rule")
            .select("folder", "rule", "level", "kind",
                    F.array_join(F.transform("tags", pretty_tag), ", ").alias("tags"),
                    F.trim(F.regexp_replace("description", r"\s+", " ")).alias("description"),
                    F.array_join("falsepositives", "; ").alias("falsepositives")))
