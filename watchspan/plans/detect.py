"""From stored events and rules to alerts with evidence."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchspan.operators.bursts import find_bursts
from watchspan.operators.chains import find_chains
from watchspan.operators.correlation import Correlation, merge_of, rule_list
from watchspan.operators.evidence import (
    burst_members, chain_members, events_behind, first_events, once_each, union_all)
from watchspan.operators.matching import match_events
from watchspan.plans.lookup import between_days
from watchspan.rules import Rule, levels_of, rules_table, silenced
from watchspan.schema import BURSTS, EVIDENCE_IN_ALERT, to_timestamp_us
from watchspan.session import stable_storage, use_utc

BURST_COLUMNS = [field.split()[0] for field in BURSTS.split(", ")]


@dataclasses.dataclass(frozen=True)
class Found:
    """Bursts and chains of all rules, and (alert_id, event_id, ...) for each of them."""

    bursts: DataFrame
    evidence: DataFrame | None


@dataclasses.dataclass(frozen=True)
class Detection:
    alerts: DataFrame
    evidence: DataFrame


def as_matches(bursts: DataFrame, correlations: list[Correlation]) -> DataFrame:
    """A burst or chain seen as a match: it happens at its trigger and carries its group values."""
    names = rule_list(bursts.sparkSession, [(c.name, c.group_by) for c in correlations],
                      "rule string, names array<string>")
    return bursts.join(names, "rule").select(
        "rule", F.col("trigger_us").alias("ts_us"), F.col("alert_id").alias("match_id"),
        F.lit("").alias("entity"), F.map_from_arrays("names", "grp").alias("fields"))


def _same_event_twice(correlation: Correlation, by_name: dict[str, Correlation]) -> bool:
    """Can one event reach an alert of this correlation on two ways?"""
    if len(correlation.rules) > 1:
        return True
    inner = None if correlation.kind == "merge" else by_name.get(correlation.rules[0])
    return inner is not None and _same_event_twice(inner, by_name)


def correlate(matches: DataFrame, levels: list[list[Correlation]],
              keep: Callable[[DataFrame], DataFrame] = lambda df: df, prune: bool = False) -> Found:
    """Run correlations level by level; each level sees the matches of rules and of earlier levels.

    ``keep`` is applied to what later steps read again, such as the bursts of a level. ``prune``
    leaves out groups that cannot fire, at the cost of one more pass over the matches.
    """
    by_name = {c.name: c for level in levels for c in level if c.kind != "merge"}
    all_bursts: list[DataFrame] = []
    evidence: list[DataFrame] = []
    counts: list[DataFrame] = []
    for depth, level in enumerate(levels):
        inner = union_all(evidence)
        # What a later level looks its events up in is read again for the alerts.
        again = {r for later in levels[depth + 1:] for c in later for r in c.rules}
        found: list[DataFrame] = []
        for ordered in (False, True):
            chosen = [c for c in level if (c.kind == "temporal_ordered") == ordered]
            if not chosen:
                continue
            bursts = keep((find_chains if ordered else find_bursts)(matches, chosen, prune))
            found.append(bursts.select(*BURST_COLUMNS))
            rows = (chain_members(bursts, chosen) if ordered
                    else burst_members(matches, bursts, chosen))
            on_alerts = any(r in by_name for c in chosen for r in c.rules if c.kind != "merge")
            behind = events_behind(rows, list(by_name), inner if on_alerts else None)
            twice = [c.name for c in chosen if _same_event_twice(c, by_name)]
            if len(twice) < len(chosen):
                plain = behind.filter(~F.col("rule").isin(twice)) if twice else behind
                referred = again & {c.name for c in chosen if c.kind != "merge"} - set(twice)
                evidence.append(keep(plain) if referred else plain)
            if twice:
                single = keep(once_each(behind.filter(F.col("rule").isin(twice))))
                evidence.append(single)
                counts.append(single.groupBy("alert_id").agg(F.count(F.lit(1)).alias("n_events")))
        all_bursts += found
        referable = [c for c in level if c.kind != "merge"]
        if referable:
            matches = matches.unionByName(as_matches(union_all(found), referable))
    bursts = union_all(all_bursts)
    if counts:
        bursts = bursts.join(union_all(counts), "alert_id", "left")
    else:
        bursts = bursts.withColumn("n_events", F.col("n_matches"))
    return Found(bursts.withColumn("count", F.coalesce("n_events", "n_matches")).drop("n_events"),
                 union_all(evidence))


def make_alerts(found: Found, rules: list[Rule], ids_in_alert: int = EVIDENCE_IN_ALERT) -> Detection:
    """Alerts of all rules that are not silenced, with the first evidence ids inside; the evidence has all."""
    spark = found.bursts.sparkSession
    loud = rules_table(spark, rules).filter(~F.col("silenced")).select(
        "rule", "title", "level", "level_rank", "description", "tags", "kind")
    names = rule_list(spark, [(r.name, r.correlation.group_by if r.correlation else ["entity"])
                              for r in rules], "rule string, names array<string>")
    alerts = found.bursts.join(loud, "rule").join(names, "rule")
    evidence = found.evidence.filter(~F.col("rule").isin(list(silenced(rules))))
    listed = (first_events(evidence, ids_in_alert).groupBy("alert_id")
              .agg(F.sort_array(F.collect_list(F.struct("pos", "event_id"))).alias("listed")))
    return Detection(
        alerts.join(listed, "alert_id").select(
            "alert_id", "rule", "title", "level", "level_rank", "description", "tags",
            F.when(F.col("kind") == "rule", "rule").otherwise("correlation").alias("kind"),
            to_timestamp_us(F.col("first_us")).alias("ts_first"),
            to_timestamp_us(F.col("last_us")).alias("ts_last"),
            to_timestamp_us(F.col("trigger_us")).alias("ts_trigger"),
            "count", F.map_from_arrays("names", "grp").alias("grp"),
            F.col("listed")["event_id"].alias("event_ids")),
        evidence)


def correlation_levels(rules: list[Rule]) -> list[list[Correlation]]:
    """Correlations by depth; the hits of loud plain rules are merged along with the first level."""
    silent = silenced(rules)
    merges = [merge_of(r.name) for r in rules if not r.correlation and r.name not in silent]
    levels = [[r.correlation for r in level] for level in levels_of(rules)]
    if merges:
        return [merges + (levels[0] if levels else []), *levels[1:]]
    return levels


def detect(events: DataFrame, rules: list[Rule],
           keep: Callable[[DataFrame], DataFrame] = stable_storage,
           ids_in_alert: int = EVIDENCE_IN_ALERT, first: str | None = None, last: str | None = None) -> Detection:
    """Alerts are a function of the events and rules alone; run again, they come out the same.

    The matches, a small part of the events, are kept, as every level reads them. ``first`` and ``last`` are days.
    """
    use_utc(events.sparkSession)
    events = between_days(events, first, last)
    matches = keep(match_events(events, rules))
    levels = correlation_levels(rules)
    if not levels:
        levels = [[merge_of(r.name) for r in rules]]
    return make_alerts(correlate(matches, levels, keep, prune=True), rules, ids_in_alert)


def by_time(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("ts_first", "rule", "alert_id")
