"""Time slices: the unit in which ordered work on one group is spread over tasks.

A group is cut into slices several spans wide, so even a group holding much of all rows is
processed by many tasks. Rows near a border are copied into the neighbouring slice, which makes
every window of one span visible inside a single slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchspan.schema import MICROS

SPANS_PER_SLICE = 4


def width(span_us: Column) -> Column:
    return F.greatest(span_us * SPANS_PER_SLICE, F.lit(MICROS))


def start_of(ts_us: Column, slice_width: Column) -> Column:
    return ts_us - F.pmod(ts_us, slice_width)


def _spread(df: DataFrame, homes: Column) -> DataFrame:
    """``part`` stands first among the partition columns: sorting compares one number, and texts only
    where it is equal."""
    return (df.withColumn("home", F.explode(homes))
            .withColumns({"slice": F.col("home")["slice"], "own": F.col("home")["own"]})
            .drop("home")
            .withColumn("part", F.xxhash64("corr", "grp", "slice")))


def _home(start: Column, own: bool) -> Column:
    return F.struct(start.alias("slice"), F.lit(own).alias("own"))


def seen_later(df: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Each row in its own slice, and in the next one if that starts within one span."""
    size = width(F.col("span_us"))
    start = start_of(F.col(ts), size)
    near = F.col(ts) + F.col("span_us") >= start + size
    return _spread(df, F.when(near, F.array(_home(start, True), _home(start + size, False)))
                   .otherwise(F.array(_home(start, True))))


def seen_earlier(df: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Each row in its own slice, and in the previous one if that ended within one span."""
    size = width(F.col("span_us"))
    start = start_of(F.col(ts), size)
    near = F.col(ts) - F.col("span_us") < start
    return _spread(df, F.when(near, F.array(_home(start, True), _home(start - size, False)))
                   .otherwise(F.array(_home(start, True))))


def covered(first: Column, last: Column, span_us: Column) -> Column:
    """Starts of all slices a closed interval touches."""
    size = width(span_us)
    return F.sequence(start_of(first, size), start_of(last, size), size)
