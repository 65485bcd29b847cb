import numpy as np
import pyarrow as pa
from llm_helpers import documents, prose
from pyspark.sql import functions as F
from test_shingles import edited, plain

from watchspan.llm import shingles, simhash
from watchspan.llm.arrays import flat


def sets_of(texts):
    return shingles.shingle_sets(*flat(pa.array(texts)))


def test_sketches_of_any_length_never_differ_in_more_bits_than_sets_in_shingles():
    texts = [edited(prose(n, n), k, 0.01 * k) for n in (3, 60, 205, 225, 430, 860, 3000) for k in range(4)]
    hashes, begin = sets_of(texts)
    sketch, width = shingles.unfolded(np.array(shingles.parity_bits(hashes, begin), object))
    assert set(width.tolist()) == {2, 4, 8, 16}
    own = [set(hashes[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
    left, right = (c.ravel() for c in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    bits = shingles.differing(sketch, width, left, right)
    assert all(b <= len(own[i] ^ own[j]) for b, i, j in zip(bits, left, right))
    assert (bits[left == right] == 0).all() and (bits[left != right] > 0).any()


def test_fingerprints_of_five_words_link_what_plain_distances_link(spark):
    texts = [edited(prose(k % 6, 300), k, 0.003 * (k % 5)) for k in range(40)]
    hashes, begin = sets_of(texts)
    sims = simhash.simhash_of_sets(hashes, begin)
    assert len(np.unique(sims)) > 8
    nodes = spark.createDataFrame([(k, int(s)) for k, s in enumerate(sims.view(np.int64))], "node long, sim long")
    got = {r.node: r.root for r in shingles.components(shingles.fingerprint_pairs(nodes)).collect()}
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if int(sims[i] ^ sims[j]).bit_count() <= simhash.DISTANCE:
                label = [label[j] if x == label[i] else x for x in label]
    least = [min(k for k, x in enumerate(label) if x == own) for own in label]
    assert [got.get(k, k) for k in range(len(texts))] == least


def test_a_group_of_near_copies_hands_on_no_more_pairs_than_it_has_entries(spark):
    base, copies = prose(1, 200), 60
    texts = [(k, edited(base, k, 0.01)) for k in range(copies)]
    docs = documents(spark, texts)
    entries = shingles.keep(shingles.file_entries(docs, np.zeros(0, np.uint64)))
    hashes, begin = sets_of([t for _, t in texts])
    known = spark.createDataFrame([(int(n), b) for n, b in zip(shingles.node_of(hashes, begin), shingles.parity_bits(hashes, begin))], "node long, bits binary")
    placed = entries.join(known, "node").withColumn("root", F.col("node"))
    every, best = (shingles.candidates(placed, None, best).select("u", "v") for best in (False, True))
    assert best.count() <= entries.count() and best.subtract(every).isEmpty()
    similar = sum(5 * len(plain(s) & plain(t)) >= 4 * len(plain(s) | plain(t)) for i, (_, s) in enumerate(texts) for _, t in texts[:i])
    assert every.count() >= similar > 10 * copies


def test_long_sketches_rule_out_what_short_ones_cannot():
    texts = [edited(prose(9, 6000), k, 0.03 * k) for k in range(4)]
    hashes, begin = sets_of(texts)
    bits = shingles.parity_bits(hashes, begin, shingles.LONGEST, shingles.FINER)
    ids = np.arange(4)[::-1].copy()
    known = shingles.Sketches(ids, bits)
    own = [set(hashes[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
    left, right = np.triu_indices(4, 1)
    size = np.array([len(x) for x in own])
    a, b, differ = known.close(left, right, known.place_of(ids[np.arange(4)]), size)
    assert all(d <= len(own[i] ^ own[j]) for i, j, d in zip(a, b, differ))
    similar = {(i, j) for i, j in zip(left, right) if 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])}
    assert similar <= set(zip(a, b)) and len(a) < len(left)
    short = shingles.Sketches(ids, shingles.parity_bits(hashes, begin))
    assert len(short.close(left, right, short.place_of(ids), size)[0]) == len(left)


def test_long_texts_that_only_share_a_shingle_hand_on_no_pairs(spark):
    texts = [prose(100 + k, 4000) for k in range(20)]
    hashes, begin = sets_of(texts)
    bits = shingles.parity_bits(hashes, begin, shingles.LONGEST, shingles.FINER)
    nodes = spark.createDataFrame([(k, b) for k, b in enumerate(bits)], "node long, bits binary")
    size = np.diff(begin)
    entries = spark.createDataFrame([(bucket, k, int(size[k]), 0, k) for bucket in (5, 6) for k in range(20)], "bucket long, node long, size int, place int, root long")
    assert shingles.candidates(entries, None, False, nodes).isEmpty()
    # A copy is found, once, though it meets the other in both buckets and their sketches are of different lengths.
    copy = entries.filter("node = 3").withColumn("node", F.lit(99).cast("long")).withColumn("root", F.col("node"))
    more = nodes.union(nodes.filter("node = 3").withColumn("node", F.lit(99).cast("long")))
    for best in (False, True):
        assert [tuple(r) for r in shingles.candidates(entries.union(copy), None, best, more).collect()] == [(3, 99, 0)]


def test_a_batch_is_made_into_sets_in_small_pieces(spark):
    def make(batch, hashes, begin):
        assert len(begin) == batch.num_rows + 1
        return pa.record_batch([pa.array([batch.num_rows]), pa.array([sum(len(t.encode()) for t in batch.column("text").to_pylist())])], names=["n", "size"])

    docs = documents(spark, [(k, prose(k, 300)) for k in range(400)] + [(400, prose(7, 60_000))])
    made = shingles._per_text(docs.coalesce(1), ["text"], "n long, size long", make).collect()
    assert sum(r.n for r in made) == 401
    assert all(r.n == 1 or r.size <= 1 << 18 for r in made) and max(r.size for r in made) > 1 << 18
