"""Toxicity: logistic regression trained by FTRL-proximal over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters and digits; a text's features are the distinct hashes, in 2^BITS slots, of its
words, word beginnings, pairs of neighbours, triples and pairs with one word between. FTRL keeps a learning rate per coordinate and sets
every weight to zero that L1 does not find worth keeping, so that the model is a short list of slots and weights, which
is sent to the tasks; its length is bounded by the slots of the training sample, and ``fit`` checks it against ``MOST``.
Scores are computed where the texts lie.

The classifier is fitted on a bounded sample: the ``sample`` labelled rows (of those allowed) with the smallest hash of
their id, each with all its features. Their feature slots are made in parallel; the passes of the learner itself run in
one task, which lays the rows in a temporary file and maps it, so that its memory does not grow with their length.

Defined cases: a null or empty text has no features and scores by the intercept alone; of several labels for one
document the highest counts; a null label is none; without labelled rows every score is 0.5 less a hair (predicted 0);
repeated rows each get a row; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.llm.arrays import flat, hashed_words, mix, pieces
from watchspan.llm.common import table

BITS, SAMPLE, MOST = 20, 20_000, 200_000
#: Distances between the words of a feature; None: the first bytes of a word, which inflected forms share.
SHAPES, BEGINNING = ((), (1,), (1, 2), (2,), None), 6


@dataclass(frozen=True)
class Model:
    slots: np.ndarray
    weights: np.ndarray
    intercept: float


def slots_of(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct features of each text; with ``known``, a table of slots, only of those in it."""
    words, row, begun = hashed_words(data, offsets, BEGINNING)
    rows, slots = [], []
    for kind, shape in enumerate(SHAPES):
        n = len(words) - max(shape or (), default=0)
        if n <= 0:
            continue
        at = slice(0, n)
        parts = [begun] if shape is None else [words[at], *[words[d:n + d] for d in shape]]
        slot = (mix(kind, *parts) >> np.uint64(64 - BITS)).astype(np.int64)
        fits = row[at] == row[len(row) - n:]
        if known is not None:
            fits &= known[slot]
        rows.append(row[at][fits])
        slots.append(slot[fits])
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[r << BITS | s for r, s in zip(rows, slots)]]))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0,
         passes: int = 5, toxic_weight: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights of all slots and the intercept, which is not regularised. Slots of a row have the value 1.

    Toxic rows, the rarer ones, count ``toxic_weight`` times.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        own = z[at]
        out = np.where(np.abs(own) > l1, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)
        out[-1] = -own[-1] * alpha / (beta + np.sqrt(n[at][-1]))
        return out

    for k in range(passes):
        for r in np.random.default_rng(k).permutation(len(rows)):
            at = np.append(rows[r], size)
            w = weights(at)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[r]
            gradient *= toxic_weight if labels[r] else 1.0
            sigma = (np.sqrt(n[at] + gradient * gradient) - np.sqrt(n[at])) / alpha
            z[at] += gradient - sigma * w
            n[at] += gradient * gradient
    final = weights(np.arange(size + 1))
    return final[:-1], float(final[-1])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE) -> Model:
    """From (doc_id, text) and (doc_id, toxic); ``allowed`` says, of a ``doc_id``, whether its label may be learned."""
    own = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if allowed is not None:
        own = own.filter(allowed)
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, slot = slots_of(*flat(batch.column("text")))
            begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            cells = [slot[a:b].astype(np.int32).tobytes() for a, b in zip(begin[:-1], begin[1:])]
            yield pa.record_batch([batch.column("toxic"), pa.array(cells, pa.binary())], names=["toxic", "slots"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, labels, digests = [0], [], []
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                labels += batch.column("toxic").to_pylist()
                for cell in batch.column("slots"):
                    cell = cell.as_buffer()
                    file.write(cell)
                    ends.append(ends[-1] + len(cell) // 4)
                    digests.append(xxhash.xxh64_intdigest(cell))
            if not labels:
                return
            file.flush()
            data = np.memmap(file, np.int32, "r") if ends[-1] else np.zeros(0, np.int32)
            # Tasks may deliver rows in any order; the learner must not depend on it.
            order = sorted(range(len(labels)), key=lambda k: (digests[k], labels[k]))
            weights, intercept = ftrl([data[ends[k]:ends[k + 1]] for k in order], np.array(labels, float)[order])
            used = np.flatnonzero(weights)
            yield pa.record_batch([pa.array([used.astype(np.int32).tobytes()], pa.binary()), pa.array([weights[used].tobytes()], pa.binary()),
                                   pa.array([intercept])], names=["slots", "weights", "intercept"])

    found = texts.mapInArrow(features, "toxic int, slots binary").repartition(1).mapInArrow(train, "slots binary, weights binary, intercept double").first()
    if found is None:
        return Model(np.zeros(0, np.int32), np.zeros(0), -1e-9)
    model = Model(np.frombuffer(bytes(found.slots), np.int32), np.frombuffer(bytes(found.weights)), found.intercept)
    if len(model.slots) > MOST:
        raise ValueError(f"{len(model.slots)} weights are too many to send to all tasks; raise l1")
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, score)."""
    slots, weights, intercept = model.slots, model.weights, model.intercept

    def run(batches):
        table = np.zeros(1 << BITS)
        table[slots] = weights
        known = table != 0
        for batch in pieces(batches):
            row, slot = slots_of(*flat(batch.column("text")), known)
            total = np.bincount(row, table[slot], minlength=batch.num_rows) + intercept
            yield pa.record_batch([batch.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -500, 500))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = fit(docs, table(spark, sf_dir, "labels", ["doc_id", "toxic"]), ~held_out())
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))
