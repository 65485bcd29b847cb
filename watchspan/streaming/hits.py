"""Plain rules on a growing event table, as a stream.

Detection proper is a batch job over all stored events. What needs no look back, matching, and what
needs only a short one, merging the hits of one rule and entity, also runs while events come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.operators.matching import match_events
from watchspan.rules import Rule
from watchspan.schema import EVENTS, MERGE_GAP_SECONDS
from watchspan.session import use_utc


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (use_utc(spark).readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def hit_stream(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per new event and plain rule it fulfils. Keeps no state."""
    return match_events(events, rules).withColumn("ts", F.timestamp_micros("ts_us"))


def merged_hit_stream(hits: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Hits of one rule and entity over gaps of up to five minutes, given out once nothing can join them.

    The state per rule and entity is one open session, however many hits it holds.
    """
    session = F.session_window("ts", f"{MERGE_GAP_SECONDS} seconds")
    return (hits.withWatermark("ts", lateness).groupBy(session, "rule", "entity")
            .agg(F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last"), F.count(F.lit(1)).alias("count"))
            .drop("session_window"))
