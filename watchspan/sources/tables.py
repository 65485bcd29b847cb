"""Alerts, their evidence and ground truth as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.plans.detect import Detection

SCENARIO = ("array<struct<name: string, description: string, source: string, ips: array<string>, "
            "host: string, start: double, end: double, expect: array<string>>>")
TRUTH = f"seed bigint, start double, hours bigint, benign_events map<string,bigint>, scenarios {SCENARIO}"


def replace_alerts(detection: Detection, path: str) -> None:
    """Alerts are rebuilt as a whole by every run."""
    detection.alerts.write.mode("overwrite").parquet(f"{path}/alerts")
    detection.evidence.write.mode("overwrite").parquet(f"{path}/evidence")


def read_alerts(spark: SparkSession, path: str) -> Detection:
    return Detection(spark.read.parquet(f"{path}/alerts"), spark.read.parquet(f"{path}/evidence"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).json(path, multiLine=True)


def scenarios_of(truth: DataFrame) -> DataFrame:
    """One row per scenario, numbered in file order."""
    return truth.select(F.posexplode("scenarios").alias("scenario_id", "s")).select("scenario_id", "s.*")


def benign_events_of(truth: DataFrame) -> DataFrame:
    return truth.select(F.aggregate(F.map_values("benign_events"), F.lit(0).cast("bigint"),
                                    lambda total, n: total + n).alias("benign_events"))
