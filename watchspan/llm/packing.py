"""Best-fit packing of token sequences, online and in bounded space.

Each task packs the documents of its partition as they come, so no text or id is shuffled. A document longer than a
sequence is cut into whole sequences; its last piece is packed like a short one. A piece goes into the open bin with
the least free space that still holds it: bins are keyed by free space in a bitset, and the lowest set bit at or above
the length of the piece is the best fit. If none fits, a bin is opened; there are at most ``open_bins``, and the
fullest closes for it. Bins still open at the end of a task, at most ``open_bins`` each, are packed once more among
all tasks by the same rule, the longest first.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for itself; an empty table
gives none; other columns are ignored. Ties between bins of equal free space go to the one filled last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.llm.arrays import flat, pieces
from watchspan.llm.common import keep, table
from watchspan.llm.tokens import encoder_of

SEQUENCE = 4096
OPEN_BINS = 128


class BestFit:
    """Bins with something in them, by free space. ``add`` returns a bin that had to close, or None."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most, self.count, self.bits = size, open_bins, 0, 0
        self.by_free: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        own = self.by_free[free]
        found = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def add(self, length: int, item) -> list | None:
        """The item is kept with the place at which it begins in its bin."""
        if length >= self.size:
            return [(0, item)]
        fit = self.bits >> length
        closed = None
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            target = self._take(free)
        else:
            if self.count >= self.most:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)
            free, target = self.size, []
        target.append((self.size - free, item))
        free -= length
        if not free:
            return target
        self.by_free.setdefault(free, []).append(target)
        self.bits |= 1 << free
        self.count += 1
        return closed

    def rest(self) -> Iterator[list]:
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


PIECE = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, open boolean"


def pack_tokens(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", size: int = SEQUENCE,
                open_bins: int = OPEN_BINS) -> DataFrame:
    """(doc_id, text) -> a row per piece; ``ids`` are little-endian 32-bit numbers. Whole sequences leave together."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = encoder_of(tokenizer), BestFit(size, open_bins)
        number, out = TaskContext.get().partitionId() << 40, []

        def close(packed: list | None, still_open: bool = False) -> None:
            nonlocal number
            for offset, (doc_id, k, start, ids) in packed or ():
                out.append((doc_id, k, start, len(ids) // 4, ids, number, offset, still_open))
            if packed:
                number += 1

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in pieces(batches, limit=8 << 20):
            ids, first = encoder.encode(*flat(batch.column("text")))
            first, ids = first.tolist(), ids.astype("<u4")
            for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[first[row]:first[row + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                for k in range(0, len(own), 4 * size):
                    cut = own[k:k + 4 * size]
                    close(bins.add(len(cut) // 4, (doc_id, k // (4 * size), k // 4, cut)))
            if out:
                yield flush()
        for packed in bins.rest():
            close(packed, True)
        if out:
            yield flush()

    first = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE))
    rest = first.filter("open").groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("length"))
    moved = repack(rest, size)
    again = first.filter("open").join(moved, "sequence_id").select(
        "doc_id", "piece", "start", "length", "ids", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return first.filter("not open").drop("open").unionByName(again)


def repack(rest: DataFrame, size: int, per_task: int = 1 << 14) -> DataFrame:
    """(sequence_id, length) -> (sequence_id, into, shift): open bins put together, ``per_task`` or so at a time."""
    def run(batches):
        bins = BestFit(size, size)
        done = []
        for batch in batches:
            for name, length in zip(batch.column("sequence_id").to_pylist(), batch.column("length").to_pylist()):
                done.append(bins.add(length, name))
        rows = []
        for packed in [*done, *bins.rest()]:
            rows += [(name, packed[0][1], shift) for shift, name in packed or ()]
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["sequence_id", "into", "shift"])

    rest = keep(rest)
    tasks = rest.count() // per_task + 1
    return keep(rest.repartition(tasks, F.pmod(F.xxhash64("sequence_id"), F.lit(tasks))).sortWithinPartitions(F.desc("length"), "sequence_id")
                .mapInArrow(run, "sequence_id long, into long, shift long"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    if docs is None:
        docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    packed = pack_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
