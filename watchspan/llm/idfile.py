"""Token ids in files: canonical, length-limited Huffman codes.

Pass one encodes texts into ids, keeps them as 16- or 32-bit numbers and counts each id over all documents. From the
counts the driver builds the code: package-merge gives the best lengths of at most ``longest`` bits, and lengths alone
fix a canonical code. Pass two deals the documents by ranges of ``doc_id`` and writes each as a bit stream of its own with
the bit offset of every ``BLOCK``-th id; files ascend, and rows in them. Reading takes a table of 2^(longest length) entries
that gives id and length for the next bits; all blocks of a batch are decoded side by side, as each starts at its checkpoint.

Layout of a path: ``code`` (one row: length of the code of each id, bytes) and ``docs`` (part, before: ids of the part's
earlier documents, doc_id, n_tokens, checkpoints as little-endian 32-bit offsets, bits). Parts are numbered as the files are.

Defined cases: a null or empty text is the end id alone; documents of one ``doc_id`` follow each other by a hash of their ids
and, if equal, in any order, over several parts if there are many; a null id comes first; repeated rows are written each for
itself; without rows there is no code and reading gives none; an id that occurs alone gets a code of one bit; any number of
different ids fits (codes grow beyond ``LONGEST`` bits if they are too many for it); other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchspan.llm.arrays import flat, pieces
from watchspan.llm.common import keep, shared_folder, table
from watchspan.llm.tokens import encoder_of

LONGEST, BLOCK, PART_TOKENS = 16, 256, 1 << 24


def code_lengths(counts: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Package-merge: the length of each symbol's code, 0 where it does not occur.

    ``longest`` is ``LONGEST``, or one bit more than codes of one length would need if that is more.
    """
    used = np.flatnonzero(counts)
    longest = longest or max(LONGEST, int(len(used) - 1).bit_length() + 1 if len(used) > 1 << LONGEST else 0)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids cannot have codes of at most {longest} bits")
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))
        both = both[rank]
        packages = both[0:len(both) - 1:2] + both[1::2]
    need, depth = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for symbols in reversed(levels):
        taken = int(symbols[:need].sum())
        depth[:taken] += 1
        need = 2 * (need - taken)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        size = int(lengths[symbol])
        if size:
            code <<= size - last
            codes[symbol], code, last = code, code + 1, size
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the next bits, as many as the longest code has: the id, and how many of them are its code."""
    codes, used, longest = canonical(lengths), np.flatnonzero(lengths), int(lengths.max(initial=0))
    size = lengths[used].astype(np.int64)
    first, span = codes[used].astype(np.int64) << (longest - size), 1 << (longest - size)
    ids, bits = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    place = np.repeat(first - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
    ids[place], bits[place] = np.repeat(used, span), np.repeat(size, span)
    return ids, bits


def encode_bits(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all documents of a batch, each from a byte of its own: bytes, where each begins, bit offset of each id in its document."""
    size = lengths[ids].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(size)])
    total = upto[first[1:]] - upto[first[:-1]]
    begin = np.concatenate([[0], np.cumsum((total + 7) // 8)])
    counts = np.diff(first)
    inside = upto[:-1] - np.repeat(upto[first[:-1]], counts)
    at = inside + np.repeat(begin[:-1] * 8, counts)
    word, end, code = at >> 6, (at & 63) + size, codes[ids]
    over = np.maximum(end - 64, 0)
    head = (code >> over.astype(np.uint64)) << np.maximum(64 - end, 0).astype(np.uint64)
    out = np.zeros(int(begin[-1] // 8) + 2, np.uint64)
    if len(ids):
        runs = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[runs]] = np.bitwise_or.reduceat(head, runs)
        spill = np.flatnonzero(over)
        out[word[spill] + 1] |= code[spill] << (64 - over[spill]).astype(np.uint64)
    return out.astype(">u8").view(np.uint8), begin, inside


def decode_blocks(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, table_ids: np.ndarray, table_bits: np.ndarray) -> np.ndarray:
    """Ids of blocks that begin at the given bits, one block after the other."""
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].copy(), counts[order]
    target = (np.cumsum(counts) - counts)[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    active, longest = len(order), len(table_ids).bit_length() - 1
    for step in range(int(left[0]) if active else 0):
        active = int(np.searchsorted(-left[:active], -step, "left"))
        now = at[:active]
        byte = now >> 3
        window = (data[byte].astype(np.uint32) << 24) | (data[byte + 1].astype(np.uint32) << 16) | (data[byte + 2].astype(np.uint32) << 8) | data[byte + 3]
        entry = (window >> (32 - longest - (now & 7)).astype(np.uint32)) & np.uint32((1 << longest) - 1)
        out[target[:active] + step] = table_ids[entry]
        now += table_bits[entry]
    return out


def _keep_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """doc_id and ids of each document; a row without ``ids`` holds counts of (some) ids of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        width = np.dtype("<u2") if max(encoder.tokenizer.get_vocab_size(), end_id) < 1 << 16 else np.dtype("<u4")
        counts = np.zeros(max(encoder.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        for batch in pieces(batches, limit=8 << 20):
            ids, first = encoder.encode(*flat(batch.column("text")))
            ids = np.insert(ids, first[1:], end_id)
            first = first + np.arange(len(first))
            counts += np.bincount(ids, minlength=len(counts))
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(np.diff(first)),
                pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(first * width.itemsize), pa.py_buffer(ids.astype(width))]).cast(pa.binary()),
                pa.nulls(batch.num_rows, pa.binary())], names=["doc_id", "n_tokens", "ids", "counts"])
        if counts.any():
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([0]), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                                  names=["doc_id", "n_tokens", "ids", "counts"])

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, counts binary").write.option("compression", "zstd").parquet(path)


def _total_counts(kept: DataFrame) -> np.ndarray:
    """Counts of all tasks, added up by id; what comes to the driver is a row per id of the vocabulary."""
    def run(batches):
        for batch in batches:
            for cell in batch.column("counts").to_pylist():
                counts = np.frombuffer(cell, np.int64)
                used = np.flatnonzero(counts)
                yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    rows = kept.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, path: str, scratch: str) -> None:
    spark = docs.sparkSession
    _keep_ids(docs, tokenizer, end_id, scratch)
    kept = spark.read.parquet(scratch)
    lengths = code_lengths(_total_counts(kept))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    codes = canonical(lengths)
    rows = kept.filter("ids is not null").select("doc_id", "n_tokens", "ids")
    total = rows.agg(F.sum("n_tokens").alias("n")).first().n or 0
    parts = max(1, -(-total // PART_TOKENS))
    # Equal rows differ by their place among the rows kept, so that no range of keys has to be in one part.
    keys = ["doc_id", "hash", "place"]
    dealt = (rows.withColumns({"hash": F.xxhash64("ids"), "place": F.monotonically_increasing_id()})
             .repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "n_tokens", "ids"))

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                own = batch.slice(k, 1024)
                count = own.column("n_tokens").to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.cumsum(count)])
                data, offsets = flat(own.column("ids"))
                ids = data.view("<u2" if offsets[-1] == 2 * first[-1] else "<u4").astype(np.int64)
                out, begin, inside = encode_bits(ids, first, lengths, codes)
                blocks = -(-count // BLOCK)
                marks = np.repeat(first[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
                ends = np.concatenate([[0], np.cumsum(blocks)]) * 4
                yield pa.record_batch([
                    pa.array(np.full(len(count), part)), pa.array(before + first[:-1]), own.column("doc_id"), own.column("n_tokens"),
                    _binary(inside[marks].astype("<u4").view(np.uint8), ends), _binary(out[:begin[-1]], begin)],
                    names=["part", "before", "doc_id", "n_tokens", "checkpoints", "bits"])
                before += int(first[-1])

    coded = dealt.mapInArrow(run, "part long, before long, doc_id long, n_tokens long, checkpoints binary, bits binary")
    coded.write.option("compression", "none").parquet(f"{path}/docs")


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, before, doc_id, n_tokens, ids): ``ids`` as little-endian 32-bit numbers, decoded from the files."""
    code = spark.read.parquet(f"{path}/code").first()
    table_ids, table_bits = decoding_table(np.frombuffer(bytes(code.lengths), np.uint8))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                own = batch.slice(k, 2048)
                count = own.column("n_tokens").to_numpy(zero_copy_only=False)
                data, begin = flat(own.column("bits"))
                marks, ends = flat(own.column("checkpoints"))
                blocks = np.diff(ends) // 4
                inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                sizes = np.minimum(BLOCK, np.repeat(count, blocks) - BLOCK * inner)
                ids = decode_blocks(data, np.repeat(begin[:-1] * 8, blocks) + marks.view("<u4"), sizes, table_ids, table_bits)
                first = np.concatenate([[0], np.cumsum(count)])
                yield pa.record_batch([own.column("part"), own.column("before"), own.column("doc_id"), own.column("n_tokens"),
                                       _binary(ids.astype("<u4").view(np.uint8), first * 4)], names=["part", "before", "doc_id", "n_tokens", "ids"])

    docs = spark.read.parquet(f"{path}/docs").select("part", "before", "doc_id", "n_tokens", "checkpoints", "bits")
    return docs.mapInArrow(run, "part long, before long, doc_id long, n_tokens long, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``: ids of all documents before. Only the parts' totals meet in one task."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(totals, "part").withColumn("start", F.col("before") + F.col("offset")).drop("before", "offset")


def op8_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents", ["doc_id", "text"]), public_tokenizers.path("byte_bpe_50k.json"), 2, f"{folder}/files", f"{folder}/scratch")
    digests = read_ids(spark, f"{folder}/files").select("part", "before", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(keep(digests)).select("doc_id", "start", "n_tokens", "ids_crc32")
