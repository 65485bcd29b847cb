from collections import Counter, defaultdict

from llm_helpers import documents, empty, odd_texts, prose
from watchspan.llm import sharding


def check(rows, shards):
    places, sizes = defaultdict(list), Counter()
    for r in rows:
        places[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) <= set(range(shards))
    return sizes


def test_bytes_are_near_equal_and_slots_gapless(spark):
    texts = [(k, prose(k, 20 + k % 50)) for k in range(1500)] + [(5000 + k, prose(1, 60)) for k in range(700)]  # a hot group of equal texts
    docs = documents(spark, texts)
    got = sharding.histogram_shards(docs, 8, piece_bytes=2000)
    assert set(docs.columns) | {"shard", "slot"} == set(got.columns)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(k for k, _ in texts)
    sizes = check(rows, 8)
    assert max(sizes.values()) - min(sizes.values()) < 2 * max(len(t.encode()) for _, t in texts)
    # in key order over all shards
    key = {(r.doc_id, r.text): r.key for r in docs.select("doc_id", "text", sharding.key_of().alias("key")).collect()}
    ordered = [key[r.doc_id, r.text] for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)


def test_odd_rows(spark):
    texts = list(odd_texts().items()) + [(5, odd_texts()[5]), (5, odd_texts()[5]), (None, "x"), (None, None)]
    rows = sharding.histogram_shards(documents(spark, texts), 4).collect()
    check(rows, 4)
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in texts)
    assert sharding.histogram_shards(empty(spark), 4).count() == 0
    one = sharding.histogram_shards(documents(spark, {1: "a"}), 16).collect()
    assert len(one) == 1 and one[0].slot == 0
