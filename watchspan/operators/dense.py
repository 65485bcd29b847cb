"""Ordered work on groups of any density.

A group whose points in time fit into one task is ordered as a whole. A denser one is cut into buckets at quantiles of its
points, so that every bucket holds about as many, however few spans they lie in. Running sums and maxima then have two levels: inside
each bucket, and over one row per bucket, whose exclusive prefix is carried into the bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchspan.session import stable_storage

GROUP = ["corr", "grp"]
#: Points that are ordered in one task.
PER_BUCKET = 250_000
#: Cuts are looked up in blocks of so many.
BLOCK = 64


def has_dense_groups(points: DataFrame) -> bool:
    """Whether some group has more points than one task should order. Counted on the map side first."""
    return not points.groupBy(*GROUP).count().filter(F.col("count") > PER_BUCKET).isEmpty()


def cuts_of(points: DataFrame) -> DataFrame:
    """(corr, grp, cuts) of groups with more than ``PER_BUCKET`` points (corr, grp, at): quantiles in ascending order.

    Groups are taken together by size, as all groups of one aggregation get equally many cuts.
    """
    doublings = F.floor(F.log2(F.col("count") / PER_BUCKET)).cast("int")
    counts = stable_storage(points.groupBy(*GROUP).count().filter(F.col("count") > PER_BUCKET).withColumn("doublings", doublings))
    parts = []
    for size in sorted(r.doublings for r in counts.select("doublings").distinct().collect()):
        buckets = 2 ** (size + 1)
        quantiles = F.percentile_approx("at", [k / buckets for k in range(1, buckets)], 20 * buckets)
        own = points.join(counts.filter(F.col("doublings") == size).select(*GROUP), GROUP, "left_semi")
        parts.append(own.groupBy(*GROUP).agg(F.array_distinct(quantiles).alias("cuts")))
    none = points.select(*GROUP, F.array("at").alias("cuts")).limit(0)
    return stable_storage(reduce(DataFrame.unionByName, parts, none))


def placed(df: DataFrame, cuts: DataFrame, at: str, name: str = "bucket") -> DataFrame:
    """Adds the number of the bucket that ``at`` falls into; groups without cuts have bucket 0."""
    blocks = F.transform(F.sequence(F.lit(1), F.size("cuts"), F.lit(BLOCK)), lambda i: F.element_at("cuts", i))
    full = F.size(F.filter(blocks, lambda c: c <= F.col(at)))  # blocks that begin at or before
    inside = F.slice("cuts", (F.greatest(full, F.lit(1)) - 1) * BLOCK + 1, BLOCK)
    number = (F.greatest(full, F.lit(1)) - 1) * BLOCK + F.size(F.filter(inside, lambda c: c <= F.col(at)))
    return df.join(cuts, GROUP, "left").withColumn(name, F.when(F.col("cuts").isNull() | (F.size("cuts") == 0), 0).otherwise(number)).drop("cuts")


def carried(df: DataFrame, keys: list[str], bucket: str, later: bool = False, **values: tuple[Column, Column | str]) -> DataFrame:
    """Adds to each row, per ``name=(of a bucket, over buckets)``, what holds over all earlier (or ``later``) buckets of its ``keys``.

    Both are aggregates; the second is given the first's column by name. NULL where there is no such bucket.
    """
    order = F.desc(bucket) if later else F.asc(bucket)
    others = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(*[own.alias(name) for name, (own, _) in values.items()])
    prefix = totals.select(*keys, bucket, *[over(name).over(others).alias(name) for name, (_, over) in values.items()])
    return df.join(prefix, [*keys, bucket], "left")
