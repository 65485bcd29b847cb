"""Near copies by exact similarity of shingle sets: every pair of texts whose sets have a Jaccard similarity of 0.8 or more.

Shingles are five words in a row (lower-cased A-Z, parted by ASCII white space) as 64-bit hashes; a text of fewer words is
one shingle. Texts with equal sets are one node. Two sets of a and b shingles at 0.8 or more differ in at most (a + b) / 9,
so in any order of all shingles they share one in the first fifth of both; each set is filed under those. A pair that meets
in a bucket is looked at if its places there leave at most (a + b) / 9 for what differs before, and is then verified on the
whole sets, unless a sketch of parity bits, as long as the set needs, shows already that they differ in more. Shingles found often in a sample come
last in the order, which keeps common passages out of the buckets; the order does not change what is found.

SimHash comes first: sets whose fingerprints link (``simhash.forest``) are verified and joined. What fingerprints miss (many
copies at 0.8 differ in more than three bits) is looked for in the buckets, there only between different components. An entry
hands on its partner with the fewest differing bits of the sketch: first of its neighbours by size, then, twice, of the whole
bucket, and what these links left apart is at last compared pair by pair. So a group of copies sends on rows in proportion to
its entries, and no pair is verified twice. Buckets are dealt in parts, and each part gets one sketch of every set it has entries
of; a pair that meets in many buckets of a part leaves it once.

Defined cases: texts without a word have the same empty set; repeated rows each get a row; a null ``doc_id`` is no candidate
for ``component_id`` (null only if nobody else is in the component); an empty table gives none; other columns are ignored.
Sets are compared by 48 bits of their shingles' hashes, everything else by 64; of two texts of 20,000 words, the chance that
one shingle counts as shared by mistake is about 10^-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchspan.llm.arrays import SPACES, flat, hashed_words, mix, packed, pieces, unpacked
from watchspan.llm.common import keep
from watchspan.llm.links import components
from watchspan.llm.simhash import forest, group_ids, simhash_of_sets

WORDS = 5
#: Texts looked at for common shingles, from how many of them on a shingle is common, and how many are listed at most.
SAMPLE, OFTEN, MOST = 10_000, 8, 400_000
#: Neighbours by size that are verified first, and pairs handed on at a time.
NEAREST, BLOCK = 3, 1 << 18
#: Bits of the sketch that rules pairs out before their sets are compared: looked at first, at least, and of very long sets.
PARITY, FEWEST, LONGEST, FINER = 1024, 128, 1 << 17, 2
#: Entries of a part of the buckets, parts at least, and numbers of long sketches compared at a time.
PART, PARTS, WORDS_AT_ONCE = 1 << 19, 24, 1 << 22
#: Bytes of text made into sets at a time; the arrays on the way take many times as much.
TEXT = 1 << 18
ENTRY = "bucket long, node long, size int, place int"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a batch, sorted, one text after the other, and where each text begins."""
    words, row = hashed_words(data, offsets, word=~SPACES)
    rows = len(offsets) - 1
    end = np.cumsum(np.bincount(row, minlength=rows))
    first = end - np.bincount(row, minlength=rows)
    begin = np.arange(len(words))
    begin = begin[(begin + WORDS <= end[row]) | (begin == first[row])]
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    at = row[begin]
    shingles = mix(*[np.where(begin + d < end[at], padded[begin + d], np.uint64(0)) for d in range(WORDS)])
    order = np.lexsort((shingles, at))
    shingles, at = shingles[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (at[1:] != at[:-1])
    return shingles[new], np.concatenate([[0], np.cumsum(np.bincount(at[new], minlength=rows))])


def node_of(shingles: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number for each set."""
    return np.array([xxhash.xxh64_intdigest(shingles[a:b]) for a, b in zip(begin[:-1], begin[1:])], np.uint64).view(np.int64)


def _per_text(docs: DataFrame, columns: list[str], out: str, make: Callable) -> DataFrame:
    """``make`` gets a batch of ``columns`` and the sets of its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=TEXT):
            yield make(batch, *shingle_sets(*flat(batch.column("text"))))

    return docs.select(*columns).mapInArrow(run, out)


def common_shingles(docs: DataFrame) -> np.ndarray:
    count = docs.count()
    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(min(1.0, SAMPLE / max(count, 1)) * 1_000_000))
    found = _per_text(sampled, ["text"], "shingle long", lambda batch, shingles, begin: pa.record_batch([pa.array(shingles.view(np.int64))], names=["shingle"]))
    rows = found.groupBy("shingle").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "shingle").limit(MOST).select("shingle").toArrow()
    return np.sort(rows.column("shingle").to_numpy().view(np.uint64))


def file_entries(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """The first fifth of each set, common shingles last; only what meets another set is kept."""
    def make(batch, shingles, begin):
        size = np.diff(begin)
        at = np.repeat(np.arange(len(size)), size)
        often = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles if len(common) else np.zeros(len(shingles), bool)
        order = np.lexsort((shingles, often, at))
        place = np.arange(len(at)) - begin[:-1][at]
        use = place < (size - -(-4 * size // 5) + 1)[at]
        at, place = at[use], place[use]
        return pa.record_batch([pa.array(shingles[order][use].view(np.int64)), pa.array(node_of(shingles, begin)[at]), pa.array(size[at].astype(np.int32)),
                                pa.array(place.astype(np.int32))], names=["bucket", "node", "size", "place"])

    def meeting(bucket, *cells):
        order = np.lexsort((cells[0], cells[1], bucket))
        bucket, *cells = (c[order] for c in (bucket, *cells))
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (cells[0][1:] != cells[0][:-1])
        bucket, *cells = (c[new] for c in (bucket, *cells))
        same = np.zeros(len(bucket) + 1, bool)
        same[1:-1] = bucket[1:] == bucket[:-1]
        use = same[1:] | same[:-1]
        yield pa.record_batch([pa.array(c[use]) for c in (bucket, *cells)], names=["bucket", "node", "size", "place"])

    return whole_buckets(_per_text(docs, ["text"], ENTRY, make), ["bucket", "node", "size", "place"], meeting, ENTRY)


def whole_buckets(entries: DataFrame, columns: list[str], make: Callable, out: str) -> DataFrame:
    """``make`` gets the columns of whole buckets, which are dealt by their number and read one after the other."""
    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            rest = own if rest is None else [np.concatenate(c) for c in zip(rest, own)]
            whole = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on in the next batch
            if whole:
                yield from make(*[c[:whole] for c in rest])
                rest = [c[whole:] for c in rest]
        if rest is not None:
            yield from make(*rest)

    return entries.select(*columns).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, out)


def candidates(entries: DataFrame, nearest: int | None, best: bool, bits: DataFrame | None = None) -> DataFrame:
    """(u, v, differ), u < v: pairs of a bucket with different ``root`` whose bits do not rule out that they are similar.

    ``nearest``: only so many neighbours by size; ``best``: for each entry the partner with the fewest differing bits.
    ``bits`` holds the sketch of each node, if the entries do not.
    """
    bits = entries.select("node", "bits").distinct() if bits is None else bits
    columns = ["bucket", "node", "size", "place", "root"]

    def make(sketches, bucket, node, size, place, root):
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bucket))))
        mixed = np.logical_or.reduceat(root != root[first][number], first)[number]
        bucket, node, size, place, root = (c[mixed] for c in (bucket, node, size, place, root))
        order = np.lexsort((node, size, bucket))
        bucket, node, size, place, root = (c[order] for c in (bucket, node, size, place, root))
        own_sketch = sketches.place_of(node)
        size, place = size.astype(np.int64), place.astype(np.int64)
        least, partner = np.full(len(node), np.iinfo(np.int64).max), np.zeros(len(node), np.int64)
        here, k = np.arange(len(bucket)), 1
        while nearest is None or k <= nearest:
            here = here[here + k < len(bucket)]
            # Sizes only grow, so what is out of reach of ``here`` stays so.
            here = here[(bucket[here] == bucket[here + k]) & (5 * size[here] >= 4 * size[here + k])]
            if not len(here):
                break
            there = here + k
            near = (root[here] != root[there]) & (9 * (place[here] + place[there]) <= size[here] + size[there])
            left, right, differ = sketches.close(here[near], there[near], own_sketch, size)
            if best:
                for own, other in ((left, right), (right, left)):
                    less = differ < least[own]
                    least[own[less]], partner[own[less]] = differ[less], other[less]
            elif len(left):
                yield node[left], node[right], differ
            k += 1
        if best:
            has = np.flatnonzero(least < np.iinfo(np.int64).max)
            if len(has):
                yield node[has], node[partner[has]], least[has]

    def run(batches):
        part, sketches, ids, blobs, rest, waiting, held = None, None, [], [], None, [], 0

        def collect(cells):
            """Adds the pairs of whole buckets; gives some back when too many wait."""
            nonlocal waiting, held
            for a, b, differ in make(sketches, *cells):
                waiting.append((a, b, differ))
                held += len(a)
                if held > BLOCK:
                    waiting = [_once(waiting)]
                    held = len(waiting[0][0])
                    if 2 * held > BLOCK:
                        yield _pairs(waiting)
                        waiting, held = [], 0

        def finish():
            nonlocal waiting, held
            if rest is not None:
                yield from collect(rest)
            if held:
                yield _pairs(waiting)
            waiting, held = [], 0

        for batch in batches:
            number = batch.column("part").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]])
            for begin, end in zip(edges[:-1], edges[1:]):
                if begin == end:
                    continue
                if number[begin] != part:
                    yield from finish()
                    part, sketches, ids, blobs, rest = number[begin], None, [], [], None
                # The sketches of a part come before its buckets.
                piece = batch.slice(begin, end - begin)
                sent = piece.num_rows - piece.column("bits").null_count
                if sent:
                    ids.append(piece.column("node").slice(0, sent).to_numpy(zero_copy_only=False))
                    blobs += piece.column("bits").slice(0, sent).to_pylist()
                if sent == piece.num_rows:
                    continue
                if sketches is None:
                    sketches, blobs = Sketches(np.concatenate(ids), blobs), []
                own = [piece.column(c).slice(sent).to_numpy(zero_copy_only=False) for c in columns]
                rest = own if rest is None else [np.concatenate(c) for c in zip(rest, own)]
                whole = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on in the next batch
                if whole:
                    yield from collect([c[:whole] for c in rest])
                    rest = [c[whole:] for c in rest]
        yield from finish()

    parts = entries.count() // PART + PARTS
    dealt = entries.select(F.pmod(F.xxhash64("bucket"), F.lit(parts)).cast("int").alias("part"), *columns)
    sent = dealt.select("part", "node").distinct().join(bits, "node")
    none = {c: F.lit(None).cast(kind) for c, kind in (("bucket", "long"), ("size", "int"), ("place", "int"), ("root", "long"))}
    rows = dealt.withColumn("bits", F.lit(None).cast("binary")).unionByName(sent.withColumns(none))
    found = rows.repartition("part").sortWithinPartitions("part", F.asc_nulls_first("bucket")).mapInArrow(run, "u long, v long, differ long")
    return found.groupBy("u", "v").agg(F.min("differ").alias("differ"))


def _once(waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, differ = (np.concatenate(c) for c in zip(*waiting))
    return tuple(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), differ], axis=1), axis=0).T.copy())


def _pairs(waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in _once(waiting)], names=["u", "v", "differ"])


class Sketches:
    """The sketches of a part's sets: folded to ``PARITY`` bits or fewer for a first look, and those of long sets whole."""

    def __init__(self, ids: np.ndarray, blobs: list[bytes]):
        order = np.argsort(ids)
        self.ids, bits = ids[order], np.array(blobs, object)[order]
        self.sketch, self.width = unfolded(bits)
        self.whole = np.array([len(b) // 8 for b in bits], np.int64)
        long = np.flatnonzero(self.whole > self.width)
        self.words = np.frombuffer(b"".join(bits[long].tolist()), np.uint64)
        self.begin = np.zeros(len(bits), np.int64)
        self.begin[long] = np.cumsum(self.whole[long]) - self.whole[long]

    def place_of(self, node: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, node)

    def close(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs whose sketches differ in few enough bits, and in how many."""
        out = [(left[:0], right[:0], np.zeros(0, np.int64))]
        for j in range(0, len(left), BLOCK):
            a, b = left[j:j + BLOCK], right[j:j + BLOCK]
            differ = differing(self.sketch, self.width, at[a], at[b])
            close = 9 * differ <= size[a] + size[b]
            a, b, differ = a[close], b[close], differ[close]
            long = np.flatnonzero(np.minimum(self.whole[at[a]], self.whole[at[b]]) > PARITY // 64)
            if len(long):
                differ[long] = self._long(at[a[long]], at[b[long]])
                close = 9 * differ <= size[a] + size[b]
                a, b, differ = a[close], b[close], differ[close]
            out.append((a, b, differ))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _long(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        differ = np.zeros(len(left), np.int64)
        for m, n in np.unique(np.stack([self.whole[left], self.whole[right]], axis=1), axis=0).tolist():
            own, step = np.flatnonzero((self.whole[left] == m) & (self.whole[right] == n)), max(1, WORDS_AT_ONCE // (m + n))
            for j in range(0, len(own), step):
                k = own[j:j + step]
                a, b = (folded(self.words[self.begin[side[k]][:, None] + np.arange(w)], min(m, n)) for side, w in ((left, m), (right, n)))
                differ[k] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return differ


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, width), axis=1)


def parity_bits(shingles: np.ndarray, begin: np.ndarray, most: int = PARITY, finer: int = 1) -> list[bytes]:
    """``PARITY`` bits of each set, fewer for small ones, up to ``most`` for long ones; ``finer`` times as many for each.

    Two sets differ in at least as many shingles as in bits.
    """
    rows = len(begin) - 1
    at = np.repeat(np.arange(rows), np.diff(begin)) * PARITY + (shingles % np.uint64(PARITY)).astype(np.int64)
    full = np.packbits(np.bincount(at, minlength=rows * PARITY).astype(np.uint8).reshape(rows, PARITY) & 1, axis=1, bitorder="little").view(np.uint64)
    out: list[bytes] = [b""] * rows
    width, size = PARITY, np.diff(begin)
    while True:
        # Fewer than three fifths as many bits as shingles would not tell unrelated texts apart.
        less = (5 * width // 2 >= 3 * finer * size) if width > FEWEST else np.zeros(rows, bool)
        for k in np.flatnonzero(~less):
            out[k] = out[k] or full[k].tobytes()
        if not less.any():
            break
        width //= 2
        full, size = full[:, :width // 64] ^ full[:, width // 64:], np.where(less, size, PARITY * PARITY)
    for k in np.flatnonzero(5 * PARITY < 3 * finer * np.diff(begin)):
        own, width = shingles[begin[k]:begin[k + 1]], PARITY
        while width < most and 5 * width < 3 * finer * len(own):
            width *= 2
        if width > PARITY:
            out[k] = np.packbits((np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()
    return out


def unfolded(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of numbers, longer ones folded, zeros after the end of shorter ones, and how many numbers each has."""
    width = np.array([len(b) // 8 for b in bits], np.int64)
    sketch = np.zeros((len(bits), PARITY // 64), np.uint64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        rows = np.frombuffer(b"".join(bits[own].tolist()), np.uint64).reshape(-1, w)
        sketch[own, :min(w, PARITY // 64)] = folded(rows, min(w, PARITY // 64))
    return sketch, np.minimum(width, PARITY // 64)


def differing(sketch: np.ndarray, width: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many bits the sketches differ, the longer one folded to the length of the shorter."""
    sides, short = [], np.minimum(width[left], width[right])
    for own in (left, right):
        rows, wide = sketch[own], width[own].copy()
        while (wide > short).any():
            for w in np.unique(wide[wide > short]):
                at = np.flatnonzero((wide == w) & (wide > short))
                rows[at, :w // 2] ^= rows[at, w // 2:w]
                rows[at, w // 2:w] = 0
                wide[at] = w // 2
        sides.append(rows)
    return np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v) of the pairs whose sets, made again from one text for each node, are similar."""
    nodes = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    # Kept, so that its size is known and the texts need not be shuffled to meet it.
    wanted = keep(rows.join(nodes, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("text_hash", "doc_id")).alias("one")).select("one.*"))
    texts = docs.select("text", _hash().alias("_hash"), F.col("doc_id").cast("long").alias("_id")).join(
        wanted, (F.col("_hash") == F.col("text_hash")) & F.col("_id").eqNullSafe(F.col("doc_id")), "left_semi")

    def make(batch, shingles, begin):
        short = [np.unique(shingles[a:b] >> np.uint64(16)) for a, b in zip(begin[:-1], begin[1:])]
        return pa.record_batch([pa.array(node_of(shingles, begin)), pa.array([len(x) for x in short], pa.int64()), pa.array([packed(x) for x in short], pa.binary())],
                               names=["node", "n", "shingles"])

    def compare(batches):
        for batch in batches:
            keeps = np.zeros(batch.num_rows, bool)
            for k, (a, m, b, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "m", "b", "n")))):
                shared = len(np.intersect1d(unpacked(a, m), unpacked(b, n), assume_unique=True))
                keeps[k] = 5 * shared >= 4 * (m + n - shared)
            yield pa.record_batch([batch.column("u").filter(pa.array(keeps)), batch.column("v").filter(pa.array(keeps))], names=["u", "v"])

    # Repeated rows give the same set again.
    sets = _per_text(texts, ["text"], "node long, n long, shingles binary", make).groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    left = sets.select(F.col("node").alias("u"), F.col("n").alias("m"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), "n", F.col("shingles").alias("b"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "a", "m", "b", "n").mapInArrow(compare, "u long, v long")


def nearest_partners(pairs: DataFrame) -> DataFrame:
    """The pair with the fewest differing bits of each node."""
    partner = lambda own, other: pairs.groupBy(own).agg(F.min_by(other, F.struct("differ", other)).alias(other)).select("u", "v")
    return partner("u", "v").union(partner("v", "u")).distinct()


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v), u < v, of (node, sim): sets with the same fingerprint, and one pair for each link of two fingerprints."""
    firsts = keep(nodes.groupBy("sim").agg(F.min("node").alias("first")))
    same = nodes.join(firsts, "sim").filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    at = lambda fp, node: firsts.select(F.col("sim").alias(fp), F.col("first").alias(node))
    links = forest(firsts.select(F.col("sim").alias("fp"))).distinct().join(at("u", "_u"), "u").join(at("v", "_v"), "v")
    return same.union(links.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))).distinct()


def _hash() -> Column:
    return F.xxhash64("text")


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id), a row for each row of ``docs``; ``fp`` is the number of the text's set."""
    def make(batch, shingles, begin):
        return pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(node_of(shingles, begin)), pa.array(parity_bits(shingles, begin, LONGEST, FINER), pa.binary()),
                                pa.array(simhash_of_sets(shingles, begin).view(np.int64))], names=["doc_id", "text_hash", "fp", "bits", "sim"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _hash().alias("text_hash"))
    rows = keep(_per_text(named, ["doc_id", "text", "text_hash"], "doc_id long, text_hash long, fp long, bits binary, sim long", make))
    nodes = keep(rows.groupBy(F.col("fp").alias("node")).agg(F.min("bits").alias("bits"), F.min("sim").alias("sim")))
    tried = keep(fingerprint_pairs(nodes.select("node", "sim")))
    close = keep(verified(tried, docs, rows))
    roots = keep(components(close))
    entries = keep(file_entries(docs, common_shingles(named)))
    for nearest, best in ((NEAREST, True), (None, True), (None, True), (None, False)):
        placed = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = keep(candidates(placed, nearest, best, nodes.select("node", "bits")))
        pairs = keep((nearest_partners(found) if best else found.select("u", "v")).join(tried, ["u", "v"], "left_anti"))
        if not pairs.isEmpty():
            close = keep(close.union(verified(pairs, docs, rows)))
            roots = keep(components(close))
            tried = tried.union(pairs)
        if nearest is None:
            if found.isEmpty():
                break
            # Whoever has no partner in another component now will never have one.
            entries = entries.join(found.select(F.col("u").alias("node")).union(found.select("v")).distinct(), "node", "left_semi")
    return group_ids(rows.select("doc_id", "text_hash", "fp"), roots)
