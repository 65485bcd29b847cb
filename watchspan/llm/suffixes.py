"""Suffix-array dedup: bytes that lie in a string of ``length`` bytes which also starts in a document of smaller id.

Suffixes need an order only to the depth of ``length`` bytes, and only those that can tie with another document's. Both come
from a difference cover D of a period v: of any two suffixes, some offset below v leads both to sample positions
(position mod v in D). So two equal strings of ``length`` bytes share a sample string of ``length - v + 1`` bytes.

1. Documents are dealt by ranges of id and packed into blocks, kept in the shared folder. So all documents of one block have
   smaller ids than those of the next, and "smaller id" is "earlier block" but inside a block. Documents of an id
   that may also be in a neighbouring partition get blocks of their own.
2. Cover sample: the sample strings of each block, sorted by a 64-bit key, are dealt to key buckets. One bucket at a time is
   sorted; a sample that ties with another block's is ranked, the rest tie with nobody. Blocks get back one bit a sample.
3. Suffixes: only those that reach a ranked sample within v bytes, or one that several documents of the block have, can tie
   beyond it. Their keys over ``length`` bytes are dealt to buckets, sorted one bucket at a time, and each run of ties is resolved to
   the least id; blocks get back one bit a suffix: does an earlier block have it?
4. Bits, together with the ties inside the block, mark what is removed.

A block sends a key once however often it has it, so a passage that a third of all rows hold is a few rows in its bucket. A bucket
holds a bounded number of keys, as their number follows the input. Blocks are stored bucketed by their label, so they
are not shuffled again. Keys are polynomials over the bytes modulo 2^64, mixed, and stand for their strings: n suffixes have a false
tie with a chance of about n^2 / 2^65, 10^-4 at 30 GB. Keys order suffixes by hash and not by letter; nothing here needs the latter.

Defined cases: a null or empty text has no bytes; a null ``doc_id`` is neither smaller nor larger than another, so its text stays whole
and removes nothing; documents of equal ids do not remove from each other; repeated rows each get their row; a very long text
is a block of its own, keyed in slices; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.llm.arrays import flat, packed, unpacked
from watchspan.llm.common import keep, shared_folder, table, text_of
from watchspan.session import shuffles_dropped

#: Bytes of text in a block, bytes keyed at a time, blocks' bytes for each partition, keys in a bucket.
BLOCK, SLICE, PER_PART, PER_BUCKET = 2 << 20, 1 << 19, 16 << 20, 3_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def difference_cover(period: int) -> list[int]:
    """The least set, in order of size, whose differences are all residues of ``period``; found by trying."""
    def grow(chosen: list[int], size: int) -> list[int] | None:
        if len(chosen) == size:
            return chosen if len({(a - b) % period for a in chosen for b in chosen}) == period else None
        for nxt in range(chosen[-1] + 1, period):
            found = grow([*chosen, nxt], size)
            if found:
                return found
        return None

    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    while True:
        found = grow([0], size) if size == 1 else grow([0, 1], size) or grow([0], size)
        if found:
            return found
        size += 1


class Cover:
    """Period, sample residues and sample length for strings of ``length`` bytes. These periods have covers without a spare difference.

    A longer period takes fewer samples, but they are shorter and tie more often, which brings more suffixes.

    Keys of samples keep ten bits more than it takes to number ``total`` bytes: a false tie only brings suffixes that then tie with nobody.
    """

    def __init__(self, length: int, total: int):
        self.length = length
        self.mask = np.uint64((1 << 64) - (1 << max(0, 54 - total.bit_length())))
        self.period = max(v for v in (1, 3, 7, 13, 21, 31) if v <= max(1, 3 * length // 10))
        self.width = length - self.period + 1
        self.sampled = np.zeros(self.period, bool)
        self.sampled[difference_cover(self.period)] = True


def keys_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key of the ``width`` bytes at each of the ascending places ``at``."""
    out = np.empty(len(at), np.uint64)
    size = SLICE + width
    power = np.full(size, _BASE, np.uint64)
    back = np.full(size, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    edges = np.searchsorted(at, np.arange(0, len(data) + SLICE, SLICE))
    upto = np.zeros(size + 1, np.uint64)
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a == b:
            continue
        part = data[k * SLICE:k * SLICE + size]
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:len(part)], out=upto[1:len(part) + 1])
        own = at[a:b] - k * SLICE
        h = (upto[own + width] - upto[own]) * back[own]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        out[a:b] = h ^ (h >> np.uint64(32))
    return out


class Block:
    """The texts of one block, in order of id."""

    def __init__(self, ids: bytes, ends: bytes, text: bytes, cover: Cover):
        self.ids, self.cover = np.frombuffer(ids, np.int64), cover
        self.offsets = np.concatenate([[0], np.frombuffer(ends, np.int64)])
        self.data = np.frombuffer(text, np.uint8)

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the cover sample."""
        sizes = np.diff(self.offsets)
        room = np.where(sizes >= self.cover.length, sizes - self.cover.width + 1, 0)
        inner = np.flatnonzero(np.resize(self.cover.sampled, room.max(initial=0)))
        count = np.searchsorted(inner, room)
        first = np.cumsum(count) - count
        at = np.repeat(self.offsets[:-1], count) + inner[np.arange(count.sum()) - np.repeat(first, count)]
        return at, keys_at(self.data, at, self.cover.width) & self.cover.mask

    def suffixes(self, ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the suffixes that reach a ranked sample."""
        row = self.rows_of(ranked)
        begin = np.maximum(self.offsets[row], ranked - self.cover.period + 1)
        stop = np.minimum(ranked, self.offsets[row + 1] - self.cover.length) + 1
        open_ = begin < stop
        at = np.flatnonzero(_covered(begin[open_], stop[open_], len(self.data)))
        return at, keys_at(self.data, at, self.cover.length)


def _covered(begin: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    steps = np.bincount(begin, minlength=size + 1).astype(np.int32) - np.bincount(stop, minlength=size + 1).astype(np.int32)
    return np.cumsum(steps)[:size] > 0


class Keys:
    """The distinct keys of a block in order, the bucket of each, and which of its documents have them."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, buckets: int):
        order = np.argsort(keys, kind="stable")  # places ascend, and so do ids within a key
        keys, ids = keys[order], ids[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        self.keys = keys[first]
        #: Least and greatest id that has the key.
        self.least, self.most = ids[first], ids[np.append(first[1:], len(keys)) - 1] if len(keys) else ids
        self.of = np.empty(len(keys), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.edges = np.searchsorted(self.keys, [np.uint64(-(-(k << 64) // buckets)) for k in range(buckets)])
        self.edges = np.append(self.edges, len(self.keys))

    def sent(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, number of keys, the keys)."""
        for k, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:])):
            if a < b:
                yield k, int(b - a), packed(self.keys[a:b])

    def flags(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """The bits that came back, in order of the keys."""
        out = np.zeros(len(self.keys), bool)
        for k, bits in answers or ():
            a, b = self.edges[k], self.edges[k + 1]
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a)).astype(bool)
        return out


BLOCKS = "part long, block long, lo long, hi long, ids binary, ends binary, text binary"


def _labels(spark: SparkSession, parts: int) -> list[int]:
    """For each partition a number that Spark files in the bucket of this partition."""
    spread = spark.range(20 * parts + 200).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("bucket"))
    found = {r.bucket: r.id for r in spread.groupBy("bucket").agg(F.min("id").alias("id")).collect()}
    return [found[k] if k in found else next(iter(found.values())) for k in range(parts)]


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Documents packed into blocks in order of id, as a table bucketed by ``part``."""
    spark = docs.sparkSession
    labels = _labels(spark, parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), F.monotonically_increasing_id().alias("n"))
    dealt = rows.repartitionByRange(parts, "doc_id", "n").sortWithinPartitions("doc_id").select("doc_id", "text")

    def make(batches):
        # Texts of one id are held together: ``run`` is the id at hand, ``rest`` whole ids before it.
        partition = TaskContext.get().partitionId()
        label, number = labels[partition % parts], partition << 32
        rest: list[tuple] = []
        run: list[tuple] = []
        held = {"rest": 0, "run": 0}
        first = last = object()

        def block(rows):
            nonlocal number
            ids = np.array([0 if i is None else i for i, _ in rows], np.int64)
            none = rows[0][0] is None
            out = pa.record_batch([pa.array([label], pa.int64()), pa.array([number], pa.int64()), pa.array([None if none else int(ids[0])], pa.int64()),
                                   pa.array([None if none else int(ids[-1])], pa.int64()), pa.array([ids.tobytes()]),
                                   pa.array([np.cumsum([len(t) for _, t in rows], dtype=np.int64).tobytes()]), pa.array([b"".join(t for _, t in rows)], pa.binary())],
                                  names=["part", "block", "lo", "hi", "ids", "ends", "text"])
            number += 1
            return out

        def settle(alone):
            """Puts the run at hand behind the whole ids before it, or into a block of its own."""
            nonlocal rest, run
            if rest and (alone or held["rest"] + held["run"] > BLOCK):
                yield block(rest)
                rest, held["rest"] = [], 0
            if run and alone:
                yield block(run)
            elif run:
                rest, held["rest"] = rest + run, held["rest"] + held["run"]
            run, held["run"] = [], 0

        pure = True  # the first id of a partition may also be in the one before
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if doc_id != last and last is not first:
                    yield from settle(pure)
                    pure = False
                elif run and held["run"] + len(text) > BLOCK:
                    yield from settle(True)
                    pure = True
                last = doc_id
                run.append((doc_id, text))
                held["run"] += len(text)
        yield from settle(True)

    name = f"watchspan_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        dealt.mapInArrow(make, BLOCKS).write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").bucketBy(parts, "part").saveAsTable(name)
    return spark.table(name)


SENT = "bucket int, part long, block long, lo long, hi long, n long, keys binary"
BACK = "part long, block long, bucket int, bits binary"


def _sent(keys: Keys, part, number, lo, hi) -> pa.RecordBatch:
    rows = [(k, part, number, lo, hi, n, blob) for k, n, blob in keys.sent()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.int32(), *[pa.int64()] * 5, pa.binary()))],
                           names=["bucket", "part", "block", "lo", "hi", "n", "keys"])


def _in_buckets(sent: DataFrame, flag) -> DataFrame:
    """Sorts one bucket after the other. ``flag`` gets the block of each key in key order, where runs of equal keys begin, lo and hi of the blocks; it says which keys get a 1."""
    def one(found: pa.Table) -> pa.Table:
        found = found.sort_by([("part", "ascending"), ("block", "ascending")])
        counts = found["n"].to_numpy()
        keys = np.concatenate([unpacked(blob, n) for blob, n in zip(found["keys"].to_pylist(), counts.tolist())])
        block = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        run = np.ones(len(keys), bool)
        run[1:] = keys[1:] != keys[:-1]
        out = np.empty(len(keys), bool)
        out[order] = flag(block[order], np.flatnonzero(run), found["lo"].to_numpy(), found["hi"].to_numpy())
        edges = np.concatenate([[0], np.cumsum(counts)])
        bits = [np.packbits(out[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"part": found["part"], "block": found["block"], "bucket": found["bucket"], "bits": pa.array(bits, pa.binary())})

    back = keep(sent.groupBy("bucket").applyInArrow(one, BACK))
    return back.groupBy("part").agg(F.collect_list(F.struct("block", "bucket", "bits")).alias("bits"))


def _tied(block: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(first, len(block)))
    return np.repeat(sizes > 1, sizes)  # a block sends a key once, so these are of several blocks


def _seen_before(block: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    if not len(block):
        return np.zeros(0, bool)
    sizes = np.diff(np.append(first, len(block)))
    return np.repeat(np.minimum.reduceat(hi[block], first), sizes) < lo[block]


def _blocks_of(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _answers(bits: list[dict] | None, number: int) -> list[tuple[int, bytes]]:
    return [(b["bucket"], b["bits"]) for b in bits or () if b["block"] == number]


def _candidates(block: Block, buckets: int, bits) -> tuple[np.ndarray, np.ndarray]:
    at, keys = block.samples()
    own = Keys(keys, block.ids[block.rows_of(at)], buckets)
    ranked = own.flags(bits) | (own.least != own.most)
    return block.suffixes(at[ranked[own.of]])


def repeated(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): a row for each of ``docs``; spans of removed bytes, [start, stop), and the bytes that stay."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cover = Cover(length, total)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_PART))
    packed_docs = blocks(docs, parts)
    parts_of = ["part", "block", "lo", "hi", "ids", "ends", "text"]
    for_samples = max(1, -(-total * int(cover.sampled.sum()) // cover.period // PER_BUCKET))
    for_suffixes = max(1, -(-total // (3 * PER_BUCKET)))  # few bytes begin one, but all of them may

    def samples(batches):
        for part, number, lo, hi, *texts in _blocks_of(batches, parts_of):
            if lo is not None:
                block = Block(*texts, cover)
                at, keys = block.samples()
                yield _sent(Keys(keys, block.ids[block.rows_of(at)], for_samples), part, number, lo, hi)

    def suffixes(batches):
        for part, number, lo, hi, ids, ends, text, bits in _blocks_of(batches, [*parts_of, "bits"]):
            if lo is not None:
                block = Block(ids, ends, text, cover)
                at, keys = _candidates(block, for_samples, _answers(bits, number))
                yield _sent(Keys(keys, block.ids[block.rows_of(at)], for_suffixes), part, number, lo, hi)

    ranks = keep(_in_buckets(packed_docs.mapInArrow(samples, SENT), _tied))
    sent = packed_docs.join(ranks, "part", "left").select(*parts_of, "bits").mapInArrow(suffixes, SENT)
    marks = keep(_in_buckets(sent, _seen_before).withColumnRenamed("bits", "seen"))

    def spans(batches):
        for part, number, lo, hi, ids, ends, text, bits, seen in _blocks_of(batches, [*parts_of, "bits", "seen"]):
            block = Block(ids, ends, text, cover)
            removed = np.zeros(len(block.data), bool)
            if lo is not None:
                at, keys = _candidates(block, for_samples, _answers(bits, number))
                owner = block.ids[block.rows_of(at)]
                own = Keys(keys, owner, for_suffixes)
                away = at[own.flags(_answers(seen, number))[own.of] | (own.least[own.of] < owner)]
                removed = _covered(away, away + length, len(block.data))
            yield _cut(block, removed, lo is None)

    both = packed_docs.join(ranks, "part", "left").join(marks, "part", "left").select(*parts_of, "bits", "seen")
    return both.mapInArrow(spans, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _cut(block: Block, removed: np.ndarray, nameless: bool) -> pa.RecordBatch:
    before = np.zeros(len(removed) + 1, bool)
    before[1:] = removed
    before[block.offsets] = False  # spans end with their document
    start = np.flatnonzero(removed & ~before[:-1])
    after = np.zeros(len(removed) + 1, bool)
    after[:-1] = removed
    after[block.offsets] = False
    stop = np.flatnonzero(removed & ~after[1:]) + 1
    row = block.rows_of(start)
    pairs = pa.StructArray.from_arrays([pa.array(start - block.offsets[row]), pa.array(stop - block.offsets[row])], fields=list(SPAN))
    kept_upto = np.concatenate([[0], np.cumsum(~removed)])[block.offsets]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block.ids), [None, pa.py_buffer(np.ascontiguousarray(kept_upto, np.int64)), pa.py_buffer(np.ascontiguousarray(block.data[~removed]))])
    return pa.record_batch([pa.array([None] * len(block.ids) if nameless else block.ids, pa.int64()), pa.array(np.diff(block.offsets)),
                            pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(block.ids) + 1)), pa.int32()), pairs), kept.cast(pa.binary())],
                           names=["doc_id", "n_bytes", "spans", "kept"])


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeated(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
