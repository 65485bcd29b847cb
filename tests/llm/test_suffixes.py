import hashlib
import random

import numpy as np
import pytest
from llm_helpers import documents, empty, odd_texts, prose

from watchspan.llm import arrays, suffixes


def plain(texts, length=50):
    """By a table of all strings of ``length`` bytes with the least id that has them."""
    least = {}
    data = [(k, (t or "").encode()) for k, t in texts]
    for k, t in data:
        if k is not None:
            for i in range(len(t) - length + 1):
                s = t[i:i + length]
                least[s] = min(least.get(s, k), k)
    out = []
    for k, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if k is not None and least[t[i:i + length]] < k:
                gone[i:i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng, passage = random.Random(9), prose(77, 30)
    texts = list(odd_texts().items()) + [(k, None) for k in (20, 21)]
    texts[6] = (7, prose(7, 900))
    for k in range(40):
        base = prose(100 + k, 40)
        texts.append((100 + 2 * k, base))
        cut = rng.randrange(len(base) - 60)
        texts.append((101 + 2 * k, prose(300 + k, 5) + base[cut:cut + rng.choice([48, 49, 50, 51, 52, 60])] + prose(400 + k, 5)))
    texts += [(1000 + k, prose(500 + k, 4) + passage + prose(600 + k, 4) + passage[:60]) for k in range(40)]
    texts += [(2000 + k, prose(3, 30)) for k in range(30)] + [(3000 + k, "é" * (20 + k)) for k in range(12)] + [(3100, "a" * 49), (3101, "a" * 50), (3102, "a" * 300), (3103, "a" * 51)]
    texts += [(2000, prose(3, 30)), (4000, prose(8, 60)), (4000, prose(8, 60)), (4000, prose(9, 30) + prose(8, 60)), (4001, prose(8, 60)), (None, prose(8, 60)), (None, prose(8, 60)), (-5, prose(108, 40))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block, bucket, parts", [(2 << 20, 3_000_000, 4), (700, 3000, 9), (1, 500, 60)])
def test_query_equals_a_table_of_all_strings(spark, monkeypatch, tmp_path, block, bucket, parts):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "PER_BUCKET", bucket)
    monkeypatch.setattr(suffixes, "SLICE", 256)
    texts = corpus()
    documents(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = suffixes.op12_suffix_dedup(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=repr) == plain(texts)


@pytest.mark.parametrize("length", [1, 5, 16, 80])
def test_other_lengths(spark, length):
    texts = corpus()[:60]
    got = suffixes.repeated(documents(spark, texts), length).collect()
    rows = [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(rows, key=repr) == plain(texts, length)
    assert suffixes.repeated(empty(spark), length).count() == 0


@pytest.mark.parametrize("period", [1, 3, 7, 13, 21, 31, 10])
def test_any_two_residues_meet_in_the_cover(period):
    cover = suffixes.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover) == {1: 1, 3: 2, 7: 3, 13: 4, 21: 5, 31: 6}.get(period, len(cover))


def test_keys_do_not_depend_on_slices(monkeypatch):
    data = np.frombuffer(prose(1, 400).encode(), np.uint8)
    at = np.arange(len(data) - 50)
    whole = suffixes.keys_at(data, at, 50)
    monkeypatch.setattr(suffixes, "SLICE", 64)
    assert (suffixes.keys_at(data, at, 50) == whole).all() and len(set(whole.tolist())) == len(at)
    keys = np.unique(whole)
    assert (arrays.unpacked(arrays.packed(keys), len(keys)) == keys).all()


def test_blocks_are_not_shuffled_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffixes.repeated(documents(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 2, plan
