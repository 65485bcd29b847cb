"""The given tables in the shapes the library works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.session import use_utc

HOUR = 3600 * 1_000_000
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def utc(column: str = "ts") -> Column:
    """The tables hold times without a zone; all of them are UTC."""
    return F.col(column).cast("timestamp")


def text_id(column: str = "event_id") -> Column:
    """Ids as texts that sort like the numbers."""
    return F.lpad(F.col(column).cast("string"), 12, "0")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def matches(spark: SparkSession, sf_dir: str, **extra: Column) -> DataFrame:
    """The events table as a stream of matches: the rule is the event type."""
    fields = {"user_id": F.col("user_id").cast("string"), "event_type": F.col("event_type"), **extra}
    return events(spark, sf_dir).select(
        F.col("event_type").alias("rule"), F.unix_micros(utc()).alias("ts_us"),
        text_id().alias("match_id"), F.col("user_id").cast("string").alias("entity"),
        F.create_map(*[c for name, value in fields.items() for c in (F.lit(name), value)]).alias("fields"))


def address(user: Column) -> Column:
    """An address per user."""
    return F.concat(F.lit("10.0."), F.floor(user / 250).cast("string"), F.lit("."),
                    (user % 250).cast("string"))


ADDRESS_SQL = "concat('10.0.', user_id // 250, '.', user_id % 250)"


def as_sshd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as stored sshd events: errors failed, purchases got in, the rest is other."""
    action = (F.when(F.col("event_type") == "error", "failed_password")
              .when(F.col("event_type") == "purchase", "accepted").otherwise("other"))
    fields = F.create_map(F.lit("action"), action, F.lit("src_ip"), address(F.col("user_id")),
                          F.lit("user"), F.concat(F.lit("u"), F.get_json_object("props", "$.k")))
    return events(spark, sf_dir).select(
        text_id().alias("event_id"), utc().alias("ts"), F.unix_micros(utc()).alias("ts_us"),
        F.lit("ssh").alias("source"), F.concat(F.lit("host"), F.col("user_id") % 7).alias("host"),
        fields.alias("fields"), F.concat_ws(" ", "event_type", "props").alias("raw"))
