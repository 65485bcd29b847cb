"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchspan.llm.common import keep


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node points to the node's least neighbour. Small: the node and its lesser ones do.

    Each link gives one link, so neither step has to be made distinct for the next.
    """
    if large:
        sides = links.union(links.select("v", "u"))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # The link to the least one stands for the node itself.
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): every node that has a link, with the least node it can reach.

    Each round is a few joins on links only, written to the shared folder; their number is logarithmic in the length
    of the longest chain. Hot nodes are pre-aggregated, and the join side that holds them can be split.
    """
    links = keep(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _all_stars(links):
        links = keep(_stars(_stars(links, True), False).distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether every larger end has one link and no lesser end is a larger one elsewhere."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up > 0 and down > 0").isEmpty()
