"""Alerts against ground truth: what was found, how fast, and what was not asked for."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchspan.functions.fields import any_case, present
from watchspan.plans.lookup import on_days_of
from watchspan.schema import ADDRESS_FIELDS, iso_seconds
from watchspan.session import stable_storage

SLACK_SECONDS = 120
# Scenarios and alerts of a host meet by stretches of this length.
STRETCH_SECONDS = 6 * 3600


@dataclasses.dataclass(frozen=True)
class Score:
    expectations: DataFrame
    unexpected: DataFrame
    totals: DataFrame


def shown_evidence(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """What scoring needs of every event behind an alert."""
    events = on_days_of(events, evidence).select("event_id", "host", "fields")
    return evidence.select("alert_id", "event_id").join(events, "event_id")


def alert_addresses(shown: DataFrame) -> DataFrame:
    found = F.array_compact(F.array(*[present(any_case(F.col("fields"), f)) for f in ADDRESS_FIELDS]))
    return shown.select("alert_id", F.explode(found).alias("address")).distinct()


def alert_hosts(shown: DataFrame) -> DataFrame:
    return shown.select("alert_id", "host").distinct()


def involved(alerts: DataFrame, addresses: DataFrame, hosts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(alert_id, scenario_id): alerts with addresses share one with the scenario; alerts without
    any are on its host while it lasts, give or take two minutes."""
    attackers = scenarios.select("scenario_id", F.explode("ips").alias("address")).distinct()
    by_address = addresses.join(attackers, "address").select("alert_id", "scenario_id").distinct()
    first = F.unix_micros("ts_first") / 1_000_000
    stretch = lambda seconds: F.floor(seconds / STRETCH_SECONDS)
    lasts = F.sequence(stretch(F.col("start") - SLACK_SECONDS), stretch(F.col("end") + SLACK_SECONDS))
    places = (scenarios.filter((F.coalesce("host", F.lit("")) != "") & (F.col("end") + 2 * SLACK_SECONDS >= F.col("start")))
              .select("scenario_id", "host", "start", "end", F.explode(lasts).alias("stretch")))
    by_host = (alerts.join(addresses, "alert_id", "left_anti").select("alert_id", "ts_first", stretch(first).alias("stretch"))
               .join(hosts, "alert_id").join(places, ["host", "stretch"])
               .filter(first.between(F.col("start") - SLACK_SECONDS, F.col("end") + SLACK_SECONDS))
               .select("alert_id", "scenario_id"))
    return by_address.unionByName(by_host)


def expectations(alerts: DataFrame, involvement: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every (scenario, expected rule): detected or not, seconds until the earliest trigger."""
    expected = scenarios.select("scenario_id", F.col("name").alias("scenario"), "start",
                                F.posexplode("expect").alias("position", "rule"))
    hits = (alerts.select("alert_id", "rule", "ts_trigger", "ts_first").join(involvement, "alert_id")
            .groupBy("scenario_id", "rule")
            .agg(F.min(F.struct("ts_trigger", "ts_first", "alert_id")).alias("first")))
    delay = F.unix_micros(F.col("first")["ts_trigger"]) / 1_000_000 - F.col("start")
    return (expected.join(hits, ["scenario_id", "rule"], "left")
            .select("scenario_id", "position", "scenario", "rule", F.col("first").isNotNull().alias("detected"),
                    F.bround(delay, 1).alias("seconds_to_detect"),
                    F.col("first")["alert_id"].alias("alert_id")))


def unexpected_alerts(alerts: DataFrame, involvement: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Alerts no expectation accounts for: ``extra`` if they touch a scenario, else ``false positive``."""
    expected = scenarios.select("scenario_id", F.explode("expect").alias("rule")).distinct()
    claimed = (alerts.select("alert_id", "rule").join(involvement, "alert_id")
               .join(expected, ["scenario_id", "rule"], "left_semi").select("alert_id").distinct())
    touched = (involvement.join(scenarios.select("scenario_id", "name"), "scenario_id")
               .groupBy("alert_id")
               .agg(F.array_sort(F.collect_list(F.struct("scenario_id", "name")))["name"].alias("scenarios")))
    return (alerts.join(claimed, "alert_id", "left_anti").join(touched, "alert_id", "left")
            .select("alert_id", "rule", "level", iso_seconds(F.col("ts_first")).alias("time"), "count", "grp",
                    F.coalesce("scenarios", F.array().cast("array<string>")).alias("scenarios"),
                    F.when(F.col("scenarios").isNull(), "false positive").otherwise("extra").alias("verdict")))


def totals(alerts: DataFrame, expected: DataFrame, unexpected: DataFrame, benign: DataFrame) -> DataFrame:
    """One row: detected of expected, the share in percent, extra and false alerts, volume.

    Each input is read once and gives one row; the rows are added up.
    """
    figures = ["detected", "expected", "extra_alerts", "false_positives", "total_alerts", "benign_events"]

    def row(df: DataFrame, **values) -> DataFrame:
        return df.agg(*[values.get(f, F.lit(0)).cast("bigint").alias(f) for f in figures])

    parts = [row(expected, detected=F.count_if("detected"), expected=F.count(F.lit(1))),
             row(unexpected, extra_alerts=F.count_if(F.col("verdict") == "extra"),
                 false_positives=F.count_if(F.col("verdict") == "false positive")),
             row(alerts, total_alerts=F.count(F.lit(1))), row(benign, benign_events=F.sum("benign_events"))]
    summed = reduce(DataFrame.unionByName, parts).agg(*[F.sum(f).alias(f) for f in figures])
    return summed.select("detected", "expected", F.coalesce(F.try_divide(F.col("detected") * 100, F.col("expected")), F.lit(0.0)).alias("percent"),
                         *figures[2:])


def score(alerts: DataFrame, evidence: DataFrame, events: DataFrame, scenarios: DataFrame,
          benign: DataFrame) -> Score:
    shown = shown_evidence(evidence, events)
    involvement = stable_storage(involved(alerts, alert_addresses(shown), alert_hosts(shown), scenarios))
    expected = expectations(alerts, involvement, scenarios)
    unexpected = unexpected_alerts(alerts, involvement, scenarios)
    return Score(expected, unexpected, totals(alerts, expected, unexpected, benign))
