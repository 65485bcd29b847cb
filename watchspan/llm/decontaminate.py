"""Benchmark decontamination: near copies of benchmark items inside documents, by edit distance in words.

An item of n words is found where some run of words is at most floor(n / 5) edits away from it (similarity 0.8). Items
and item-sized windows are embedded by random walks (CGK): a walk reads the word under its pointer at every step, and
a random bit of that word and step says whether the pointer moves on, so that walks over similar texts fall back into
step. Where embeddings agree on a sample of their places, in any of several samples, the window is verified by the
exact edit distance to any run of words around it. ``plan`` measures on edited copies of the items, at the largest
number of edits, how many samples the target recall takes.

Windows are not placed at every word, as that takes thousands of times the work, but wherever they can match: an
item with at most e edits keeps a run of at least (n - e) / (e + 1) words, so windows are laid so that a shared run of
up to three words falls on its place. This loses nothing.

Defined cases: words are runs of ASCII letters and digits and of other characters from U+0080, with A-Z lower-cased,
and are compared by 64-bit hashes; null or empty texts match nothing, nor do items without words; an item given twice
is one; repeated documents each get their rows; empty tables give none; other columns pass through ``clean`` and are
ignored by ``matches``. Items are taken in blocks of ``BLOCK`` rows, each in one pass over the documents, so what is
sent to the executors is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.llm.arrays import flat, hashed_words, mix, pieces
from watchspan.llm.common import table

EDIT_SHARE, RUN, BLOCK = 5, 3, 20_000
WALKS, PLACES, RECALL = 32, 2, 0.99
END = np.uint64(0)


@dataclass
class Items:
    """A block of items: their words one after the other, and where shared runs lead."""

    ids: list[int]
    words: np.ndarray
    first: np.ndarray
    samples: int
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def edits(size):
    return size // EDIT_SHARE


def run_length(size: int) -> int:
    kept, gaps = size - edits(size), edits(size) + 1
    return min(RUN, -(-kept // gaps))


def embed(words: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int) -> np.ndarray:
    """The words that each walk reads in each window: steps x walks x windows."""
    out = np.zeros((steps, WALKS, len(start)), np.uint64)
    walk, at = np.arange(WALKS)[:, None], np.tile(start, (WALKS, 1))
    stop, padded = np.minimum(end, len(words)), np.append(words, END)
    for step in range(steps):
        word = padded[np.where(at < stop, at, len(words))]
        out[step] = word
        at += (mix(word, step, walk) >> np.uint64(63)).astype(np.int64)
    return out


def sampled(size: int, samples: int) -> np.ndarray:
    """Samples x ``PLACES`` of the first 2n steps; a walk moves at every other step, so it has then read about all words."""
    return (mix(size, np.arange(samples * PLACES)) % np.uint64(2 * size)).astype(np.int64).reshape(samples, PLACES)


def first_agreement(items: Items, which: np.ndarray, words: np.ndarray, start: np.ndarray, samples: int) -> np.ndarray:
    """The first sample in which an item-sized window falls into one bucket with its item in any walk, else ``samples``."""
    found = np.full(len(start), samples)
    for k in range(0, len(start), 1024):
        own = slice(k, k + 1024)
        kinds, back = np.unique(which[own], return_inverse=True)
        sizes = items.sizes[which[own]]
        steps = 2 * int(sizes.max())
        same = embed(words, start[own], start[own] + sizes, steps) == embed(
            items.words, items.first[kinds], items.first[kinds + 1], steps)[:, :, back]
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            agrees = same[:, :, at][sampled(int(size), samples)].all(axis=1).any(axis=1)
            found[k + at] = np.where(agrees.any(axis=0), agrees.argmax(axis=0), samples)
    return found


def distance(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edit distance of an item to any run of words of each region, and where the first such run ends."""
    rows, width = regions.shape
    ramp = np.arange(width + 1)
    cost = np.zeros((rows, width + 1), np.int64)
    for k, word in enumerate(item, 1):
        step = np.empty_like(cost)
        step[:, 0] = k
        step[:, 1:] = np.minimum(cost[:, :-1] + (regions != word), cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
    return cost.min(axis=1), cost.argmin(axis=1)


def _grams(words: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``length`` words within a row, and where they begin."""
    if len(words) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(words) - length + 1
    at = np.flatnonzero(row[:n] == row[length - 1:])
    return mix(*[words[at + k] for k in range(length)]), at


def prepare(ids: list[int], texts: list[str]) -> Items:
    data, offsets = flat(pa.array(texts, pa.string()))
    words, row = hashed_words(data, offsets)
    sizes = np.bincount(row, minlength=len(ids))
    used = np.flatnonzero(sizes)
    first = np.concatenate([[0], np.cumsum(sizes[used])])
    items = Items([ids[k] for k in used], words, first, 0, {})
    owner = np.repeat(np.arange(len(used)), sizes[used])
    lengths = np.array([run_length(int(n)) for n in items.sizes], np.int64)
    for length in np.unique(lengths):
        gram, at = _grams(words, owner, int(length))
        fits = lengths[owner[at]] == length
        gram, at = gram[fits], at[fits]
        order = np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
        seen = np.zeros(1 << 22, bool)
        seen[(gram >> np.uint64(42)).astype(np.int64)] = True
        items.grams[int(length)] = (gram, owner[at], at - first[owner[at]], seen)
    items.samples = plan(items)
    return items


def plan(items: Items, most: int = 128) -> int:
    """Samples per walk that find ``RECALL`` of copies with the largest number of edits."""
    if not items.ids:
        return 1
    random = np.random.default_rng(7)
    which = np.resize(np.arange(len(items.ids)), max(400, len(items.ids)))
    copies, starts, at = [], [], 0
    for k in which:
        words = list(items.words[items.first[k]:items.first[k + 1]])
        for _ in range(edits(len(words))):
            place, kind = int(random.integers(len(words) + 1)), int(random.integers(3))
            fresh = np.uint64(random.integers(1 << 62))
            if kind == 0:
                words.insert(place, fresh)
            elif place < len(words) and kind == 1:
                words[place] = fresh
            elif place < len(words) and len(words) > 1:
                del words[place]
        starts.append(at)
        copies += words
        at += len(words)
    words, starts = np.array(copies, np.uint64), np.array(starts)
    needed = np.sort(first_agreement(items, which, words, starts, most))
    return min(most, int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1)


def find(items: Items, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, distance, word): the closest place of each item in each row that has it."""
    words, row = hashed_words(data, offsets)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.concatenate([[0], np.cumsum(counts)])
    keys = []
    for length, (gram, owner, inner, seen) in items.grams.items():
        here, at = _grams(words, row, length)
        maybe = np.flatnonzero(seen[(here >> np.uint64(42)).astype(np.int64)])
        here, at = here[maybe], at[maybe]
        low, high = np.searchsorted(gram, here, "left"), np.searchsorted(gram, here, "right")
        times = high - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        keys.append(np.stack([owner[entry], np.repeat(at, times) - inner[entry], np.repeat(row[at], times)], axis=1))
    none = np.zeros(0, np.int64)
    keys = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *keys]), axis=0)
    if not len(keys):
        return none, none, none, none
    which, start, at_row = keys.T
    start = np.clip(start, begin[at_row], begin[at_row + 1])
    near = first_agreement(items, which, np.append(words, END), start, items.samples) < items.samples
    which, start, at_row = which[near], start[near], at_row[near]
    least = np.full(len(which), 1 << 30, np.int64)
    for item in np.unique(which):
        own = np.flatnonzero(which == item)
        size = int(items.sizes[item])
        more = edits(size)
        spread = np.arange(-more, size + more)
        for k in range(0, len(own), 2048):
            part = own[k:k + 2048]
            place = start[part][:, None] + spread
            inside = (place >= begin[at_row[part]][:, None]) & (place < begin[at_row[part] + 1][:, None])
            regions = np.where(inside, words[np.clip(place, 0, len(words) - 1)], END)
            least[part] = distance(items.words[items.first[item]:items.first[item + 1]], regions)[0]
    good = np.flatnonzero(least <= edits(items.sizes[which]))
    order = good[np.lexsort((start[good], least[good], which[good], at_row[good]))]
    pair = np.stack([at_row[order], which[order]], axis=1)
    best = order[np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]).any(axis=1)]))] if len(order) else order
    return at_row[best], which[best], least[best], start[best] - begin[at_row[best]]


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    ids, texts = [], []
    rows = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        if len(ids) == BLOCK:
            yield prepare(ids, texts)
            ids, texts = [], []
    if ids:
        yield prepare(ids, texts)


MATCH = "doc_id long, item_id long, distance int, item_words int, word int"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item found in it: distance in words, words of the item, first word of the window."""
    def search(items: Items):
        def run(batches):
            for batch in pieces(batches):
                row, item, far, word = find(items, *flat(batch.column("text")))
                if len(row):
                    yield pa.record_batch([
                        batch.column("doc_id").take(pa.array(row)), pa.array([items.ids[k] for k in item], pa.int64()),
                        pa.array(far, pa.int32()), pa.array(items.sizes[item], pa.int32()), pa.array(word, pa.int32())],
                        names=["doc_id", "item_id", "distance", "item_words", "word"])
        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [rows.mapInArrow(search(items), MATCH) for items in item_blocks(benchmark)]
    if not found:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), MATCH)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns. Nothing is shuffled."""
    def without(items: Items):
        def run(batches):
            for batch in pieces(batches):
                row = find(items, *flat(batch.column("text")))[0]
                stay = np.ones(batch.num_rows, bool)
                stay[row] = False
                yield batch.filter(pa.array(stay))
        return run

    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(without(items), docs.schema)
    return docs


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["item_id", "text"]))
