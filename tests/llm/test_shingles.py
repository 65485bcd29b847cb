import random

import pyarrow as pa
import pytest
from llm_helpers import documents, empty, odd_texts, prose

import corpus_pipeline
from watchspan.llm import shingles
from watchspan.llm.arrays import flat

SPACE = " \t\n\x0b\f\r"


def plain(text):
    words = (text or "").translate({ord(c): " " for c in SPACE} | {c: c + 32 for c in range(65, 91)}).split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def edited(text, seed, share):
    rng = random.Random(seed)
    words = text.split(" ")
    for k in rng.sample(range(len(words)), int(share * len(words))):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def labels(texts):
    """The least id of each component at a similarity of 0.8 or more, by comparing all."""
    sets, label = [plain(t) for _, t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or 5 * len(sets[i] & sets[j]) >= 4 * both:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    ids = [min((k for x, (k, _) in zip(label, texts) if x == own and k is not None), default=None) for own in label]
    return sorted(((k, c) for (k, _), c in zip(texts, ids)), key=str)


def corpus():
    texts, passage = list(odd_texts().items()), prose(99, 40)
    for k in range(30):
        base = prose(1000 + k, 60 + 10 * k)
        texts += [(100 + 10 * k + e, edited(base, e, 0.005 * e)) for e in range(6)]
    texts += [(600 + k, passage + prose(2000 + k, 12)) for k in range(30)]
    texts += [(700 + k, edited(prose(3, 200), k, 0.02)) for k in range(30)]
    return texts + [(None, prose(4, 80)), (None, ""), (800, prose(4, 80).upper()), (700, edited(prose(3, 200), 0, 0.02))]


def test_sets_equal_plain_splitting():
    texts = [*odd_texts().values(), "A b C d e f", "a b\tc d e F", "one two", "two one"]
    hashes, begin = shingles.shingle_sets(*flat(pa.array(texts)))
    sets = [hashes[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])]
    assert [len(s) for s in sets] == [len(plain(t)) for t in texts] and all(s == sorted(s) for s in sets)
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert len(set(sets[i]) & set(sets[j])) == len(plain(s) & plain(t))


@pytest.mark.parametrize("often, nearest", [(8, 3), (2, 1), (10**6, 1)])
def test_every_similar_pair_is_in_one_component(spark, monkeypatch, often, nearest):
    monkeypatch.setattr(shingles, "OFTEN", often)
    monkeypatch.setattr(shingles, "NEAREST", nearest)
    texts = corpus()
    got = shingles.similar_groups(documents(spark, texts)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == labels(texts)
    assert shingles.similar_groups(empty(spark)).count() == 0


def test_the_stage_drops_a_copy_that_differs_in_many_fingerprint_bits(spark):
    from watchspan.llm.simhash import near_duplicates

    base = prose(21, 300)
    close = [(k, edited(base, k, 0.02)) for k in range(1, 30)]
    close = [(k, t) for k, t in close if 5 * len(plain(t) & plain(base)) >= 4 * len(plain(t) | plain(base))]
    docs = documents(spark, [(0, base), *close])
    assert len(close) > 5 and any(r.component_id for r in near_duplicates(docs).collect())
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
