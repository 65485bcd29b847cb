import re

import numpy as np
import pytest
import xxhash
from llm_helpers import documents, empty, odd_texts, prose

from watchspan.llm import simhash
from watchspan.llm.links import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def plain(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps):
    """Least member of each component of fingerprints at three or fewer bits, by comparing all."""
    label = {f: f for f in fps}
    todo, seen = set(fps), set()
    while todo:
        group, open_ = set(), [todo.pop()]
        while open_:
            f = open_.pop()
            group.add(f)
            near = {g for g in todo if (f ^ g).bit_count() <= 3}
            todo -= near
            open_ += near
        signed = min(int(np.uint64(g).astype(np.int64)) for g in group)
        for g in group:
            label[g] = signed
        seen |= group
    return label


def test_fingerprints_equal_plain_counting(spark):
    texts = odd_texts() | {20: "Ab  CD\tef\ngh", 21: "É é Z"}
    got = {r.doc_id: r.fp for r in simhash.fingerprints(documents(spark, texts)).collect()}
    assert {k: v & (1 << 64) - 1 for k, v in got.items()} == {k: plain(t) for k, t in texts.items()}
    assert got[1] == got[2] == got[3] == 0


def test_components_and_one_of_each_group(spark):
    base = prose(1, 400)
    texts = [(k, prose(k, 80)) for k in range(50, 90)] + [(7, base), (3, base), (5, base.upper()), (3, base), (9, base + " end"), (None, prose(60, 80)),
                                                         (None, prose(500, 30)), (11, ""), (12, None), (13, " ")]
    docs = documents(spark, texts)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    want = roots({plain(t) for _, t in texts})
    least = {}
    for k, t in texts:
        if k is not None:
            least[want[plain(t)]] = min(least.get(want[plain(t)], k), k)
    for r in rows:
        assert r.component_id == least.get(want[r.fp & (1 << 64) - 1])
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len(set(want.values()))
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_per_group(empty(spark)).count() == 0


def cluster(spread, count, seed):
    rng = np.random.default_rng(seed)
    out = set()
    centre = int(rng.integers(1 << 62))
    while len(out) < count:
        f = centre
        for b in rng.choice(64, int(rng.integers(spread + 1)), replace=False):
            f ^= 1 << int(b)
        out.add(f)
    return out


@pytest.mark.parametrize("limit", [8, 2048])
def test_no_link_is_lost_in_hot_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(1 << 62, size=300)} | cluster(4, 150, 1) | cluster(12, 100, 2)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash.linked(df).collect()}
    for f, root in roots(fps).items():
        signed = int(np.uint64(f).astype(np.int64))
        assert got.get(signed, signed) == root


def test_thresholds_fulfil_the_pigeonhole_sum():
    sample = np.random.default_rng(1).integers(1 << 63, size=500).astype(np.uint64)
    for count in (100, 10**6, 10**11):
        plan = simhash.allocate(sample, count)
        assert sum(t + 1 for _, t in plan) == 4 and sorted(b for bits, _ in plan for b in bits) == list(range(64))
    assert len(simhash.allocate(sample, 10**11)) < len(simhash.allocate(sample, 1000))
    assert sum(t + 1 for _, t in simhash.allocate(np.zeros(0, np.uint64), 0)) == 4


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(2)
    free = rng.integers(1 << 32, size=2000).astype(np.uint64)
    parts = simhash.group_bits(free | (free << np.uint64(32)), 4)
    assert all(any({b, b + 32} <= set(p) for p in parts) for b in range(32))


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
