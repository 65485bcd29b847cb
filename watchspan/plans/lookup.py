"""Lookups analysts run on stored events and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchspan.operators.evidence import first_events, numbered
from watchspan.schema import LEVELS, SOURCES, iso_seconds


def between_days(events: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Events of a range of days, both included. The stored table has a folder per day: others are not read."""
    if first:
        events = events.filter(F.col("day") >= F.lit(first).cast("date"))
    return events.filter(F.col("day") <= F.lit(last).cast("date")) if last else events


def scan_events(events: DataFrame, source: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Unsorted: whoever needs an order knows how much of it."""
    events = between_days(events, first, last)
    return events.filter(F.col("source") == source) if source else events


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"))


#: Comparing with it makes a list of days something that the optimizer prunes folders by while the query runs.
FIRST_DAY = "0001-01-01"


def on_days_of(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Events on the days of ``rows.ts_us``: other folders of the stored table are not read.

    The list has a row per day, so it may go to every task. Tables without ``day``, and rows without times, leave ``events`` as they are.
    """
    if "day" not in events.columns or "ts_us" not in rows.columns:
        return events
    days = rows.select(F.to_date(F.timestamp_micros("ts_us")).alias("day")).filter(F.col("day") >= F.lit(FIRST_DAY).cast("date")).distinct()
    return events.join(F.broadcast(days), "day", "left_semi")


def events_of(ids: DataFrame, events: DataFrame) -> DataFrame:
    """Events whose id is listed in ``ids.event_id``; with ``ids.ts_us`` only their days are read."""
    return on_days_of(events, ids).join(ids, "event_id", "left_semi")


def top(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def search_events(events: DataFrame, source: str | None = None, term: str = "",
                  limit: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Newest events of a source whose raw line holds the term in any case. No wildcards."""
    found = scan_events(events, source if source in SOURCES else None, first, last)
    if term:
        found = found.filter(F.contains(F.lower("raw"), F.lower(F.lit(term))))
    return top(found.orderBy(F.desc("ts"), F.desc("event_id")), limit)


def alerts_by_time(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("ts_first", "alert_id")


def _json_text(value: Column) -> Column:
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def group_json(grp: Column) -> Column:
    """The group as ``{"name": "value", ...}``, names in order."""
    entries = F.array_sort(F.map_entries(grp))
    pairs = F.transform(entries, lambda e: F.concat(_json_text(e["key"]), F.lit(": "), _json_text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def at_least(alerts: DataFrame, level: str = LEVELS[0]) -> DataFrame:
    return alerts.filter(F.col("level_rank") >= LEVELS.index(level))


def search_alerts(alerts: DataFrame, level: str = LEVELS[0], term: str = "",
                  limit: int | None = None) -> DataFrame:
    """Worst first, then oldest. The term may stand in the rule, the title or the group."""
    found = at_least(alerts, level if level in LEVELS else LEVELS[0])
    if term:
        places = [F.col("rule"), F.col("title"), group_json(F.col("grp"))]
        held = [F.contains(F.lower(place), F.lower(F.lit(term))) for place in places]
        found = found.filter(held[0] | held[1] | held[2])
    return top(found.orderBy(F.desc("level_rank"), "ts_first", "alert_id"), limit)


def alert_events(alert_id: str, evidence: DataFrame, events: DataFrame,
                 limit: int | None = None) -> DataFrame:
    """The events behind one alert, or the first ``limit``, in time order."""
    own = evidence.filter(F.col("alert_id") == alert_id)
    shown = first_events(own, limit) if limit is not None else numbered(own)
    return (on_days_of(events, own).join(shown.select("event_id", "pos"), "event_id")
            .orderBy("ts", "event_id"))


def alerts_json(alerts: DataFrame) -> DataFrame:
    """One JSON text per alert, with the start time spelled out."""
    timed = alerts.withColumn("time", iso_seconds(F.col("ts_first")))
    return timed.select("alert_id", F.to_json(F.struct(*timed.columns)).alias("json"))


def alerts_text(alerts: DataFrame) -> DataFrame:
    """The columns of the printed list."""
    pairs = F.transform(F.map_entries("grp"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return alerts_by_time(alerts).select(
        "alert_id", iso_seconds(F.col("ts_first")).alias("time"), "level", "rule", "count",
        F.array_join(pairs, ", ").alias("group"))
