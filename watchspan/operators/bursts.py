"""Sliding-window correlations that end in burst alerts.

Per correlation and group, matches are ordered in time. A session ends where the gap to the next
match exceeds the span. Within a session the condition (so many matches, or so many distinct
values, in the trailing span) either fires or not; from its first firing, the matches of that
window and all later ones of the session form one burst.

All correlations are computed together. Matches are first counted per instant, which a map-side
combine does before any shuffle, so the amount of ordered work follows the clock resolution and
not the number of rows. What is live is a running sum of +n at an instant and -n one span later. Where a
group has too many instants for one task, all of this runs in buckets cut by density (see ``dense``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchspan.operators import dense
from watchspan.operators.correlation import Correlation, members, rule_list, without_idle_groups
from watchspan.operators.dense import GROUP
from watchspan.session import stable_storage


def _conditions(matches: DataFrame, correlations: list[Correlation]) -> DataFrame:
    rows = [(c.name, c.span_us, *c.limit) for c in correlations]
    return rule_list(matches.sparkSession, rows,
                     "corr string, span_us bigint, op string, threshold bigint")


def _counted(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every match is live for one span on its own account."""
    return (rows.groupBy(*GROUP, "ts_us").agg(F.count(F.lit(1)).alias("n"))
            .join(conditions, "corr")
            .select(*GROUP, "ts_us", "n", F.col("n").alias("up"), F.col("n").alias("down"),
                    F.lit(False).alias("none_first"), "span_us", "op", "threshold"))


def _per_value(rows: DataFrame, conditions: DataFrame, asks_for_none: bool) -> DataFrame:
    """Only a condition that asks for no values at all needs to know which match of an instant comes first."""
    first_id = F.min("match_id") if asks_for_none else F.lit(None).cast("string")
    return (rows.groupBy(*GROUP, "value", "ts_us")
            .agg(F.count(F.lit(1)).alias("n"), first_id.alias("first_id"))
            .join(conditions, "corr"))


def _neighbours(df: DataFrame, keys: list[str], cuts: DataFrame | None) -> DataFrame:
    """Adds ``before`` and ``after``: the instants next to a row's own among those of ``keys``."""
    cells = keys if cuts is None else [*keys, "bucket"]
    # A number stands first: sorting compares it, and texts only where it is equal.
    placed = (df if cuts is None else dense.placed(df, cuts, "ts_us")).withColumn("part", F.xxhash64(*cells))
    in_order = Window.partitionBy("part", *cells).orderBy("ts_us")
    out = placed.withColumns({"before": F.lag("ts_us").over(in_order), "after": F.lead("ts_us").over(in_order)})
    if cuts is None:
        return out
    out = dense.carried(out.drop("part"), keys, "bucket", last_before=(F.max("ts_us"), F.max))
    out = dense.carried(out, keys, "bucket", later=True, first_after=(F.min("ts_us"), F.min))
    return (out.withColumns({"before": F.coalesce("before", "last_before"), "after": F.coalesce("after", "first_after")})
            .drop("bucket", "last_before", "first_after"))


def _distinct(per_value: DataFrame, asks_for_none: bool, cuts: DataFrame | None) -> DataFrame:
    """A value is live while its latest occurrence is at most one span old.

    It comes up where the value was not live before and goes down one span after an occurrence
    that no other follows in time. A match without a value takes part but raises nothing.
    """
    span, at = F.col("span_us"), F.col("ts_us")
    has_value = F.col("value").isNotNull()
    marked = _neighbours(per_value, [*GROUP, "value"], cuts).withColumns({
        "up": (has_value & F.coalesce(at - F.col("before") > span, F.lit(True))).cast("bigint"),
        "down": (has_value & F.coalesce(F.col("after") - at > span, F.lit(True))).cast("bigint"),
    })
    none_first = (F.min(F.struct("first_id", (~has_value).alias("none")))["none"] if asks_for_none
                  else F.lit(False))
    return (marked.groupBy(*GROUP, "ts_us", "span_us", "op", "threshold")
            .agg(F.sum("n").alias("n"), F.sum("up").alias("up"), F.sum("down").alias("down"),
                 none_first.alias("none_first"))
            .select(*GROUP, "ts_us", "n", "up", "down", "none_first", "span_us", "op", "threshold"))


def _live_counts(instants: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """Per instant: live count before and after it, and the oldest match still in the window.

    ``n_in`` and ``n_out`` are the matches that entered and left the window so far, ``began`` is the
    first instant of the session.
    """
    nothing = F.lit(None).cast("bigint")
    none = F.lit(0).cast("bigint")
    opens = F.coalesce(F.col("ts_us") - F.col("before") > F.col("span_us"), F.lit(True))
    arrival = F.struct(F.col("ts_us").alias("at"), F.lit(0).alias("expiry"),
                       F.col("up").alias("step"), F.col("n").alias("entered"), none.alias("left"),
                       nothing.alias("oldest_next"), F.when(opens, F.col("ts_us")).alias("opened"))
    # Sorts after arrivals of the same instant: the window includes its far end.
    expiry = F.struct((F.col("ts_us") + F.col("span_us")).alias("at"), F.lit(1).alias("expiry"),
                      (-F.col("down")).alias("step"), none.alias("entered"), F.col("n").alias("left"),
                      F.col("after").alias("oldest_next"), nothing.alias("opened"))
    changes = (_neighbours(instants, GROUP, cuts)
               .withColumn("change", F.explode(F.array(arrival, expiry)))
               .select("*", "change.*").drop("change"))
    cells = GROUP
    if cuts is not None:
        cells = [*GROUP, "bucket"]
        changes = stable_storage(dense.placed(changes, cuts, "at").withColumn("part", F.xxhash64(*cells)))
    so_far = (Window.partitionBy("part", *cells).orderBy("at", "expiry")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # All of these only grow with time, but for the sum of steps.
    running = {"live": (F.sum, "step"), "n_in": (F.sum, "entered"), "n_out": (F.sum, "left"),
               "oldest": (F.max, "oldest_next"), "opened_last": (F.max, "opened"), "first_at": (F.min, "at")}
    live = changes.withColumns({name: how(column).over(so_far) for name, (how, column) in running.items()})
    if cuts is not None:
        live = dense.carried(live, GROUP, "bucket", **{f"{name}_carried": (how(column), how) for name, (how, column) in running.items()})
        join = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + b, F.max: F.greatest, F.min: F.least}
        live = live.withColumns({name: join[how](F.col(f"{name}_carried"), F.col(name)) for name, (how, _) in running.items()}).withColumn("part", F.xxhash64(*GROUP))
    return (live.filter(F.col("expiry") == 0)
            .withColumns({"oldest": F.coalesce("oldest", "first_at"), "began": F.col("opened_last")}))


def _sessions(live: DataFrame) -> DataFrame:
    """One row per session that fires. What holds at the first firing is found as a minimum, since all of it only grows."""
    before = F.col("live") - F.col("up")
    limit = F.col("threshold")
    fires = (F.when(F.col("op") == "gte", F.col("live") >= limit)
             .otherwise(((before < limit) & (limit <= F.col("live")))
                        | ((limit == 0) & (before == 0) & F.col("none_first"))))
    at_firing = {"trigger_us": "ts_us", "first_us": "oldest", "gone": "n_out"}
    return (live.withColumn("fires", fires)
            .groupBy("part", *GROUP, "began")
            .agg(F.max("ts_us").alias("last_us"), F.max("n_in").alias("entered"),
                 *[F.min(F.when(F.col("fires"), F.col(value))).alias(name) for name, value in at_firing.items()])
            .filter(F.col("trigger_us").isNotNull())
            .select(F.col("corr").alias("rule"), "grp", "first_us", "trigger_us", "last_us",
                    (F.col("entered") - F.col("gone")).alias("n_matches")))


def with_alert_id(bursts: DataFrame) -> DataFrame:
    """A stable id: the same burst of the same rule and group gets it on every run."""
    return bursts.withColumn("alert_id", F.sha1(F.to_json(F.struct("rule", "grp", "first_us"))))


def find_bursts(matches: DataFrame, correlations: list[Correlation], prune: bool = False) -> DataFrame:
    """Bursts of all given event_count, value_count, temporal and merge correlations.

    ``prune`` leaves out groups that cannot fire before anything is put in order. Instants are stored, so that the matches
    are gone through once; points per group are counted on them, as dense groups are done in another way.
    """
    def rows_of(chosen: list[Correlation]) -> DataFrame:
        rows = members(matches, chosen)
        return without_idle_groups(rows, chosen) if prune else rows

    merges = [c for c in correlations if c.kind == "merge"]
    counting = [c for c in correlations if c.kind == "event_count"]
    distinct = [c for c in correlations if c.distinct]
    parts = []
    if merges or counting:
        rows = [members(matches, merges)] if merges else []
        rows += [rows_of(counting)] if counting else []
        rows = reduce(DataFrame.unionByName, rows)
        instants = stable_storage(_counted(rows, _conditions(matches, merges + counting)))
        parts.append(_live_counts(instants, dense.cuts_of(_points(instants)) if dense.has_dense_groups(_points(instants)) else None))
    if distinct:
        asks_for_none = any(c.limit == ("eq", 0) for c in distinct)
        rows = rows_of(distinct)
        per_value = stable_storage(_per_value(rows, _conditions(matches, distinct), asks_for_none))
        cuts = dense.cuts_of(_points(per_value)) if dense.has_dense_groups(_points(per_value)) else None
        instants = _distinct(per_value, asks_for_none, cuts)
        parts.append(_live_counts(instants if cuts is None else stable_storage(instants), cuts))
    return with_alert_id(reduce(DataFrame.unionByName, [_sessions(live) for live in parts]))


def _points(instants: DataFrame) -> DataFrame:
    """All that has to be put in order: instants, and the ends of their spans."""
    return instants.select(*GROUP, F.explode(F.array(F.col("ts_us"), F.col("ts_us") + F.col("span_us"))).alias("at"))
