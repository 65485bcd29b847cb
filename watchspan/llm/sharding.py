"""Sharding by histogram sort: shards of near-equal bytes, in key order, with one exchange of the rows.

The key of a row is 64 bits: 40 of its text's hash, then 24 of its id's, so equal texts lie side by side and a large
group of them can still be parted. Where a shard begins is found without sorting: bytes below candidate boundaries,
equally spaced over the interval that is left, are counted exactly over all partitions; the boundary nearest to the
target is taken if it is within ``tolerance`` of a shard, or else the interval between two candidates that holds the
target is probed next, down to single keys. Only (key, size) is read for that, and a round sends at most 4096 counts
per boundary to the driver. Then each row is dealt once, to its piece of a shard: a range of keys of about
``PIECE`` bytes. Its place in the shard is that of its piece plus its rank within it, so no task holds a shard.

Defined cases: a null text has no bytes and counts 1; rows equal in id and text share a key, stay together and take
their slots in any order; a null id is hashed like any other; fewer rows than shards leave shards empty; an empty table
gives none; other columns stay, but those of the names that are added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchspan.llm.common import keep, table

DIGIT, TOLERANCE, PIECE = 12, 0.001, 128 << 20
TOP = 1 << 63


def key_of(text: str = "text", row_id: str = "doc_id") -> Column:
    """Signed, but in the order of its bits: hashes are spread over all 64-bit numbers either way."""
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 24), 24)
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(row_id), 40))


def splitters(marks: DataFrame, shards: int, tolerance: float) -> list[int]:
    """Keys at which shards 1 to ``shards`` - 1 begin, from (key, size)."""
    total = marks.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    found: dict[int, int] = {}
    # open intervals: (first key, width in bits) -> bytes below it and the shards that begin in it
    searched = {(-TOP, 64): (0, list(range(1, shards)))}
    while searched:
        widths = {bits for _, bits in searched}
        bits = max(widths)
        step = max(0, bits - DIGIT)
        prefix = F.shiftright("key", step) if step else F.col("key")
        inside = F.lit(True) if bits == 64 else F.shiftright("key", bits).isin([k >> bits for k, _ in searched])
        counts = {r.p: r.bytes for r in marks.filter(inside).groupBy(prefix.alias("p")).agg(F.sum("size").alias("bytes")).collect()}
        following: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for (begin, _), (below, wanted) in searched.items():
            edges = []  # (key, bytes below it)
            for p in sorted(c for c in counts if bits == 64 or c >> (bits - step) == begin >> bits):
                edges.append((p, below))
                below += counts[p]
            edges.append((None, below))
            for shard in wanted:
                target = total * shard / shards
                k = max(i for i, (_, b) in enumerate(edges[:-1]) if b <= target or i == 0)
                lower, upper = edges[k], edges[k + 1]
                near = min((lower, upper), key=lambda e: abs(e[1] - target))
                if abs(near[1] - target) <= tolerance * total / shards or not step:
                    # what follows the last key of an interval begins at the next prefix
                    found[shard] = near[0] << step if near[0] is not None else min(((edges[-2][0] + 1) << step), TOP - 1)
                else:
                    own = following.setdefault((lower[0] << step, step), (lower[1], []))
                    own[1].append(shard)
        searched = following
    return [found[s] for s in range(1, shards)]


def histogram_shards(rows: DataFrame, shards: int, text: str = "text", row_id: str = "doc_id", tolerance: float = TOLERANCE,
                     piece_bytes: int = PIECE) -> DataFrame:
    """All rows and columns with ``size``, ``shard`` and ``slot``. Write it with ``partitionBy("shard")`` to have files."""
    rows = rows.drop("size", "shard", "slot")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    marks = keep(rows.select(key_of(text, row_id).alias("key"), size.alias("size")))
    bounds = splitters(marks, shards, tolerance)
    shard = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_key"))) if bounds else F.lit(0)
    # Pieces are ranges of equal width; a range that a group of equal texts makes heavy is cut by all bits of the key's text part and 8 of its id part.
    total = marks.agg(F.sum("size")).first()[0] or 0
    bits = min(40, max(4, (2 * total // piece_bytes).bit_length()))
    heavy = [r.p for r in marks.groupBy(F.shiftright("key", 64 - bits).alias("p")).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > 4 * piece_bytes).collect()]
    piece = F.shiftright("_key", 64 - bits)
    fine = F.shiftright("_key", 16)
    where = F.struct(shard.alias("shard"), piece.alias("range"), F.when(piece.isin(heavy), fine).otherwise(F.lit(0)).alias("part")) if heavy else \
        F.struct(shard.alias("shard"), piece.alias("range"), F.lit(0).cast("long").alias("part"))
    names = ["_shard", "_range", "_part"]
    placed = lambda df: df.select("*", where.alias("_w")).select("*", *[F.col(f"_w.{n[1:]}").alias(n) for n in names]).drop("_w")
    before = Window.partitionBy("_shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed(marks.withColumnRenamed("key", "_key")).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).select(
        *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy("_key"))
    dealt = placed(rows.select("*", key_of(text, row_id).alias("_key"))).withColumn("_rank", rank)
    return dealt.join(offsets, names).select(
        *[rows[c] for c in rows.columns], size.alias("size"), F.col("_shard").cast("int").alias("shard"),
        (F.col("_offset") + F.col("_rank") - 1).cast("long").alias("slot"))


def op5_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogram_shards(table(spark, sf_dir, "documents", ["doc_id", "text"]), 16)
    return placed.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
