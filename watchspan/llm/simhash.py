"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints (64 bits over shingles of three words) are linked at three or fewer differing bits. Bits that vary
together are put into one part, by correlation on a bounded sample. If the thresholds t of the parts fulfil
sum(t + 1) = 3 + 1, every linked pair lies within t of each other in some part; a part with t = -1 is not looked at.
How many parts and which thresholds is chosen by dynamic programming on the estimated numbers of probes and candidates.
Each fingerprint is filed under its value in every part and probes the values within the part's threshold; entries
that meet are verified by the exact distance. A bucket hands on only a spanning forest of its links, and buckets with
more than ``LIMIT`` entries are filed again by pieces of their other bits, of which a linked pair shares one in four,
until they are small. So neither a group of copies nor a frequent pattern meets in one task, and no link is lost.

Defined cases: a null or empty text has fingerprint 0 and links like any other; equal texts share a fingerprint and
are one entry; repeated rows each get a row; a null ``doc_id`` is no candidate for ``component_id`` (null only if
nobody else is in the component); an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchspan.llm.arrays import LOWER, flat, pieces, single_spaced
from watchspan.llm.common import keep, table
from watchspan.llm.links import components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
LIMIT = 2048
SAMPLE = 4096
BLOCK = 1 << 18


def simhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text of a batch, as unsigned integers."""
    rows = len(offsets) - 1
    text, starts, ends, row = single_spaced(LOWER[data], offsets)
    text, words = text.tobytes(), np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(words)])
    inner = np.arange(len(starts)) - first[row]
    begin = np.flatnonzero((inner + SHINGLE <= words[row]) | (inner == 0))
    end = ends[np.minimum(begin + SHINGLE, first[row[begin] + 1]) - 1]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros((rows, BITS), np.int64)
    total = np.bincount(row[begin], minlength=rows)
    for k in range(0, len(begin), BLOCK):
        own = slice(k, k + BLOCK)
        hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts[begin[own]].tolist(), end[own].tolist())], np.uint64)
        _vote(votes, hashes, row[begin[own]])
    return _majority(votes, total)


def _vote(votes: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> None:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    votes[at[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)


def _majority(votes: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.packbits(votes * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def simhash_of_sets(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The fingerprint of each set of hashes, which lie one set after the other."""
    rows, total = len(begin) - 1, np.diff(begin)
    votes, at = np.zeros((rows, BITS), np.int64), np.repeat(np.arange(rows), total)
    for k in range(0, len(hashes), BLOCK):
        _vote(votes, hashes[k:k + BLOCK], at[k:k + BLOCK])
    return _majority(votes, total)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, fp); ``fp`` holds the 64 bits as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = simhash(*flat(batch.column("text"))).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of equal width, each begun with a free bit and filled with the free bits that correlate most with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    spread = np.sqrt((bits**2).sum(axis=0)) + 1e-12
    close = np.abs((bits / spread).T @ (bits / spread)) if len(bits) else np.zeros((BITS, BITS))
    free, out = list(range(BITS)), []
    for k in range(parts):
        own = [free.pop(0)]
        while len(own) < (BITS * (k + 1)) // parts - (BITS * k) // parts:
            best = max(free, key=lambda b: (close[b, own].sum(), -b))
            free.remove(best)
            own.append(best)
        out.append(own)
    return out


def value_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def allocate(sample: np.ndarray, count: int) -> list[tuple[list[int], int]]:
    """Parts with their thresholds, at the least estimated number of probes and candidates over ``count`` fingerprints."""
    best = None
    left, right = sample[: len(sample) // 2], sample[len(sample) // 2: len(sample) // 2 * 2]
    for parts in (4, 3, 2):
        groups = group_bits(sample, parts)
        cost = []
        for bits in groups:
            a, b = value_of(left, bits), value_of(right, bits)
            far = np.concatenate([np.bitwise_count(a ^ np.roll(b, s)) for s in range(64)]) if len(a) else np.zeros(1)
            near = [max(float((far <= t).mean()), _ball(len(bits), t) / 2.0 ** len(bits)) for t in range(DISTANCE + 1)]
            cost.append([0.0, *[count * _ball(len(bits), t) + 0.5 * count * count * near[t] for t in range(DISTANCE + 1)]])
        # least[s]: the cheapest thresholds of the parts so far whose sum of (t + 1) is s
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for own in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (spent, chosen) in least.items():
                for t in range(-1, DISTANCE - used + 1):
                    new = (spent + own[t + 1], [*chosen, t])
                    step[used + t + 1] = min(step.get(used + t + 1, new), new)
            least = step
        found = least[DISTANCE + 1]
        if best is None or found[0] < best[0]:
            best = (found[0], list(zip(groups, found[1])))
    return best[1]


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def _masks(width: int, radius: int) -> list[int]:
    """All patterns of at most ``radius`` flipped bits, without the empty one."""
    out, last = [], [0]
    for _ in range(radius):
        last = sorted({m | (1 << b) for m in last for b in range(width) if not m >> b & 1})
        out += last
    return out


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """One number for several; where two keys collide, a bucket only has more to verify."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ np.asarray(p, np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            out = out ^ (out >> np.uint64(32))
    return out


ENTRY = "bucket long, path long, fp long, role int"
FILED, PROBES = 1, 2


def _entries(bucket, path, fp, role) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(bucket).view(np.int64)), pa.array(np.full(len(fp), path, np.int64)),
                            pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), role, np.int32))],
                           names=["bucket", "path", "fp", "role"])


def file_entries(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (bits, t) in enumerate(plan):
                if t < 0:
                    continue
                value = value_of(fp, bits)
                yield _entries(_mix(k, value), 8 | k, fp, FILED | PROBES)
                for mask in _masks(len(bits), t):
                    yield _entries(_mix(k, value ^ np.uint64(mask)), 8 | k, fp, PROBES)

    return fps.select("fp").mapInArrow(run, ENTRY)


#: Paths below are split further; seven times leaves at most eight of the bits, so few different fingerprints.
DEEPEST = 1 << 17


def bits_left(path: int, plan: list[tuple[list[int], int]]) -> list[int]:
    """``path`` is 8 plus the part, then a base-4 digit for each piece that was used up."""
    digits = []
    while path >= 16:
        digits.append(path & 3)
        path >>= 2
    used = set(plan[path - 8][0])
    left = [b for b in range(BITS) if b not in used]
    for d in reversed(digits):
        own = set(_quarter(left, d))
        left = [b for b in left if b not in own]
    return left


def _quarter(bits: list[int], k: int) -> list[int]:
    return bits[len(bits) * k // 4: len(bits) * (k + 1) // 4]


def split_entries(entries: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Files entries of large buckets again, four times each, by pieces of the bits that are left."""
    def run(batches):
        for batch in batches:
            bucket, path, fp, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "path", "fp", "role"))
            bucket, fp = bucket.view(np.uint64), fp.view(np.uint64)
            for p in np.unique(path):
                for r in np.unique(role[path == p]):
                    own = (path == p) & (role == r)
                    left = bits_left(int(p), plan)
                    for k in range(4):
                        yield _entries(_mix(bucket[own], k, value_of(fp[own], _quarter(left, k))), int(p) << 2 | k, fp[own], int(r))

    return entries.select("bucket", "path", "fp", "role").mapInArrow(run, ENTRY)


class Forest:
    """Unions over small integers; ``label`` ends as the least number of each set."""

    def __init__(self, size: int):
        self.label = np.arange(size)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.count += len(a)
        if self.count > 1 << 20:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.waiting:
            a = np.concatenate([x for x, _ in self.waiting])
            b = np.concatenate([x for _, x in self.waiting])
            while True:
                x, y = self.label[a], self.label[b]
                if (x == y).all():
                    break
                np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
                while (self.label[self.label] != self.label).any():
                    self.label = self.label[self.label]
        self.waiting, self.count = [], 0
        return self.label


def bucket_links(bucket: np.ndarray, fp: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links of whole buckets, as pairs of fingerprints. Rows come sorted by bucket."""
    fps, at = np.unique(fp, return_inverse=True)
    forest, here, k = Forest(len(fps)), np.arange(len(fp)), 1
    while True:
        here = here[here + k < len(fp)]
        here = here[bucket[here] == bucket[here + k]]
        if not len(here):
            break
        there = here + k
        meet = (((role[here] & FILED) & ((role[there] & PROBES) >> 1)) | ((role[there] & FILED) & ((role[here] & PROBES) >> 1))) > 0
        near = meet & (np.bitwise_count(fp[here] ^ fp[there]) <= DISTANCE)
        forest.add(at[here[near]], at[there[near]])
        k += 1
    label = forest.settle()
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def probe(entries: DataFrame) -> DataFrame:
    """(u, v): links found in each bucket. Buckets are dealt by their number and read one after the other."""
    def run(batches):
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

        def links(parts):
            u, v = bucket_links(parts[0], parts[1].view(np.uint64), parts[2])
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rest = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("bucket", "fp", "role"))]
            whole = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on in the next batch
            if whole:
                yield links([r[:whole] for r in rest])
                rest = [r[whole:] for r in rest]
        if len(rest[0]):
            yield links(rest)

    return entries.select("bucket", "fp", "role").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def forest(fps: DataFrame) -> DataFrame:
    """(fp), distinct -> (u, v): links that join all linked fingerprints."""
    count = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()
    plan = allocate(np.array([r.fp for r in sample], np.int64).view(np.uint64), count)
    entries, found = file_entries(fps, plan), []
    while True:
        hot = keep(entries.filter(F.col("path") < DEEPEST).groupBy("bucket").count().filter(F.col("count") > LIMIT).select("bucket"))
        if hot.isEmpty():
            found.append(probe(entries))
            break
        found.append(probe(entries.join(hot, "bucket", "left_anti")))
        entries = split_entries(entries.join(hot, "bucket", "left_semi"), plan)
        entries = keep(entries.dropDuplicates(["bucket", "fp", "role"]))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def linked(fps: DataFrame) -> DataFrame:
    """(fp), distinct -> (node, root) of the fingerprints that have a link."""
    return components(forest(fps))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id), a row for each row of ``docs``."""
    rows = keep(fingerprints(docs, text))
    return group_ids(rows, linked(keep(rows.select("fp").distinct())))


def group_ids(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """``rows`` with the least ``doc_id`` of each one's component, from the (node, root) of those that have a link."""
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = keep(fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(roots.join(least, "root").select("fp", "component_id"), "fp")


def one_per_group(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` names their component, each once; rows in a component without any id stay."""
    rows = groups(docs)
    stay = keep(rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "text_hash").agg(F.min("fp").alias("fp"))
                .groupBy("doc_id", "fp").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash"))
    marked = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    found = marked.join(stay, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")), "left_semi")
    # Only rows that repeat meet; the texts of all others stay where they are.
    repeated = keep(rows.groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    one = Window.partitionBy("_id", "_hash").orderBy("_hash")
    first = found.join(repeated, same, "left_semi").withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    return found.join(repeated, same, "left_anti").unionByName(first).select("_row.*")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
