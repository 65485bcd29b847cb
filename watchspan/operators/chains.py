"""Ordered sequences: one match of each referenced rule, in order, all within one span of the first.

For every start the earliest possible continuation is taken. Starts are served oldest first, and a
start at or before the end of the last accepted chain is passed over.

As with bursts, matches are first reduced to one row per instant and the ordered steps run per time
slice. Two different rules need no more than that: of all starts with the same end, the oldest is
the accepted one. Longer chains may overlap without sharing an end; there every candidate points to
the first one starting after its own end, and the accepted ones are those that can be reached from a
candidate which overlaps no earlier one. Reaching doubles its stride per round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchspan.operators import slices
from watchspan.operators.bursts import with_alert_id
from watchspan.operators.correlation import Correlation, members, rule_list, without_idle_groups
from watchspan.operators.dense import GROUP
from watchspan.session import stable_storage

SLICE = ["part", *GROUP, "slice"]


def _shape(c: Correlation) -> tuple[bool, ...]:
    """For each step of the chain: does it repeat the rule of the step before?"""
    return tuple(a == b for a, b in zip(c.rules, c.rules[1:]))


def _count(position: int) -> Column:
    return F.col(f"n_{position}")


def _instants(matches: DataFrame, chosen: list[Correlation], shape: tuple[bool, ...],
              prune: bool) -> DataFrame:
    """Per group and instant: how many matches stand at each position, and the first two ids."""
    rows = members(matches, chosen)
    if prune:
        rows = without_idle_groups(rows, chosen)
    conditions = rule_list(matches.sparkSession, [(c.name, c.span_us) for c in chosen],
                           "corr string, span_us bigint")
    steps = range(len(shape) + 1)
    if any(shape):
        # Two ids per position are enough, and they are picked before rows are brought together.
        at_position = Window.partitionBy(*GROUP, "position", "ts_us").orderBy("match_id")
        rows = rows.withColumn("nth", F.row_number().over(at_position)).filter("nth <= 2")
    else:
        rows = rows.withColumn("nth", F.lit(1))
    here = [F.col("position") == k for k in steps]
    return (rows.groupBy(*GROUP, "ts_us")
            .agg(*[F.count_if(here[k]).alias(f"n_{k}") for k in steps],
                 *[F.min(F.when(here[k], F.col("match_id"))).alias(f"id_{k}") for k in steps],
                 *[F.max(F.when(here[k], F.col("match_id"))).alias(f"other_{k}")
                   for k in steps if any(shape)])
            .join(conditions, "corr"))


def _element(id_column: str) -> Column:
    return F.array(F.struct("ts_us", F.col(id_column).alias("match_id")))


def _candidates(instants: DataFrame, shape: tuple[bool, ...]) -> DataFrame:
    """The earliest chain from every start."""
    newest_first = Window.partitionBy(*SLICE).orderBy(F.desc("ts_us"))
    from_here = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_next = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    last = len(shape)
    df = slices.seen_earlier(instants).withColumn(
        f"chain_{last}", F.when(_count(last) > 0, _element(f"id_{last}")))
    for k in reversed(range(last)):
        following = F.col(f"chain_{k + 1}")
        if shape[k]:
            # A match cannot follow itself: take the other one of this instant, else a later one.
            other = F.concat(_element(f"other_{k}"), F.slice(following, 2, len(shape) + 1))
            rest = F.when(_count(k) >= 2, other).otherwise(
                F.last(following, ignorenulls=True).over(from_next))
        else:
            rest = F.last(following, ignorenulls=True).over(from_here)
        df = df.withColumn("rest", rest).withColumn(
            f"chain_{k}", F.when((_count(k) > 0) & F.col("rest").isNotNull(),
                                 F.concat(_element(f"id_{k}"), F.col("rest"))))
    end = F.element_at("chain_0", -1)["ts_us"]
    return (df.filter(F.col("own") & F.col("chain_0").isNotNull()
                      & (end - F.col("ts_us") <= F.col("span_us")))
            .select(*GROUP, "span_us", F.col("ts_us").alias("first_us"), end.alias("last_us"),
                    F.col("chain_0").alias("chain")))


def _oldest_per_end(candidates: DataFrame) -> DataFrame:
    return (candidates.groupBy(*GROUP, "last_us")
            .agg(F.min("first_us").alias("first_us"), F.min_by("chain", "first_us").alias("chain")))


def _linked(candidates: DataFrame) -> DataFrame:
    """``free``: overlaps no earlier candidate; ``after``: the next one that starts past its end.

    Links to free candidates are left out, those are accepted in any case.
    """
    oldest_first = Window.partitionBy(*SLICE).orderBy("first_us")
    earlier_end = F.max("last_us").over(oldest_first.rowsBetween(Window.unboundedPreceding, -1))
    marked = (slices.seen_later(candidates, "first_us")
              .withColumn("free", F.coalesce(earlier_end < F.col("first_us"), F.lit(True)))
              .filter("own").drop("slice", "own", "part"))
    borders = marked.withColumn("border", F.explode(F.array(
        F.struct(F.col("last_us").alias("at"), F.lit(0).alias("starts")),
        F.struct(F.col("first_us").alias("at"), F.lit(1).alias("starts"))))).select(
        "*", "border.*").drop("border")
    # Newest first; at one instant ends come before starts, so only later starts precede an end.
    onward = (Window.partitionBy(*SLICE).orderBy(F.desc("at"), "starts")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.when(F.col("starts") == 1, F.struct("first_us", "free"))
    return (slices.seen_earlier(borders, "at")
            .withColumn("next", F.last(start, ignorenulls=True).over(onward))
            .filter("own and starts = 0")
            .withColumn("after", F.when(~F.col("next")["free"], F.col("next")["first_us"]))
            .drop("slice", "own", "part", "at", "starts", "next"))


def _without_overlap(candidates: DataFrame) -> DataFrame:
    linked = stable_storage(_linked(candidates))
    reached = linked.filter("free").select(*GROUP, "first_us")
    hops = linked.filter("after is not null").select(*GROUP, "first_us", "after")
    while not hops.isEmpty():
        onward = reached.join(hops, [*GROUP, "first_us"]).select(
            *GROUP, F.col("after").alias("first_us"))
        reached = stable_storage(reached.union(onward).distinct())
        second = hops.select(*GROUP, F.col("first_us").alias("after"), F.col("after").alias("far"))
        hops = stable_storage(hops.join(second, [*GROUP, "after"])
                              .select(*GROUP, "first_us", F.col("far").alias("after")))
    return linked.join(reached, [*GROUP, "first_us"], "left_semi")


def find_chains(matches: DataFrame, correlations: list[Correlation], prune: bool = False) -> DataFrame:
    """Accepted chains of all given temporal_ordered correlations, with the matches they consist of.

    Columns as for bursts, plus ``chain``: array of (ts_us, match_id) in order.
    """
    by_shape: dict[tuple[bool, ...], list[Correlation]] = {}
    for c in correlations:
        by_shape.setdefault(_shape(c), []).append(c)
    parts = []
    for shape, chosen in by_shape.items():
        found = _candidates(_instants(matches, chosen, shape, prune), shape)
        parts.append(_oldest_per_end(found) if shape in ((), (False,)) else _without_overlap(found))
    chains = reduce(DataFrame.unionByName, [
        p.select(F.col("corr").alias("rule"), "grp", "first_us",
                 F.col("last_us").alias("trigger_us"), "last_us",
                 F.size("chain").cast("bigint").alias("n_matches"), "chain") for p in parts])
    return with_alert_id(chains)
