import re

import numpy as np
from llm_helpers import documents, empty, odd_texts, prose

from watchspan.llm import decontaminate as D


def edited(words, edits, seed):
    rng = np.random.default_rng(seed)
    words = list(words)
    for _ in range(edits):
        k, at = int(rng.integers(3)), int(rng.integers(len(words)))
        if k == 0:
            words.insert(at, f"new{rng.integers(1000)}")
        elif k == 1:
            words[at] = f"other{rng.integers(1000)}"
        else:
            del words[at]
    return words


def plain(a, b):
    """Least edit distance of ``a`` to any run of words of ``b``."""
    cost = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, cost[0] = cost[0], i
        for j, y in enumerate(b, 1):
            last, cost[j] = cost[j], min(last + (x != y), cost[j] + 1, cost[j - 1] + 1)
    return min(cost)


def shout(text):
    return "".join(c.upper() if c.isascii() else c for c in text)


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def setup(spark):
    items = {k: prose(1000 + k, 12 + k) for k in range(40)}
    texts, planted = {}, {}
    for k in range(120):
        body = words(prose(k, 150))
        item = k % 40
        edits = len(words(items[item])) // 5
        if k < 80:
            body[50:50] = edited(words(items[item]), edits if k < 60 else 0, k)
            planted[k] = item
        texts[k] = " ".join(body)
    benchmark = spark.createDataFrame(list(items.items()) + [(3, items[3]), (90, None), (91, ""), (92, " .!"), (None, "unfindable words")], "item_id long, text string")
    return items, texts, planted, benchmark


def test_planted_copies_with_many_edits_are_found(spark):
    items, texts, planted, benchmark = setup(spark)
    docs = documents(spark, texts)
    got = {(r.doc_id, r.item_id): r.distance for r in D.matches(docs, benchmark).collect()}
    want = {}
    for k, t in texts.items():
        for i, x in items.items():
            far = plain(words(x), words(t))
            if far <= len(words(x)) // 5:
                want[k, i] = far
    assert set(planted.items()) <= set(want)
    assert set(got) <= set(want) and all(want[p] == far for p, far in got.items())
    assert len(got) >= 0.98 * len(want)
    cleaned = D.clean(docs, benchmark)
    assert cleaned.columns == docs.columns
    left = {r.doc_id for r in cleaned.collect()}
    assert {k for k in texts if not any(p == k for p, _ in want)} <= left and left.isdisjoint(p for p, _ in got)


def test_odd_documents_items_and_blocks(spark, monkeypatch):
    items, texts, _, benchmark = setup(spark)
    monkeypatch.setattr(D, "BLOCK", 7)
    rows = list(odd_texts().items()) + [(None, items[5]), (70, shout(items[5])), (70, shout(items[5])), (71, "x " * 40_000 + items[6])]
    docs = documents(spark, rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.item_id, r.distance) for r in D.matches(docs, benchmark).collect())
    assert got == [(False, 70, 5, 0), (False, 70, 5, 0), (False, 71, 6, 0), (True, 0, 5, 0)]
    assert D.clean(docs, benchmark).count() == len(rows) - 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(docs, none).count() == 0 and D.clean(docs, none).count() == len(rows)
    assert D.matches(empty(spark), benchmark).count() == 0 and D.clean(empty(spark), benchmark).count() == 0


def test_short_items_match_exactly(spark):
    benchmark = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "one two three four")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.matches(documents(spark, {1: "an alpha", 2: "beta, Gamma", 3: "one two three five", 4: "gamma beta"}), benchmark).collect()}
    assert got == {(1, 1), (2, 2)}


def test_samples_reach_the_target_recall():
    items = D.prepare(list(range(60)), [prose(k, 20 + k) for k in range(60)])
    assert 1 <= items.samples < 128
