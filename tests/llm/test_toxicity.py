import random

import numpy as np
from pyspark.sql import functions as F

from llm_helpers import documents, empty, odd_texts, prose
from watchspan.llm import toxicity


def corpus():
    rng = random.Random(3)
    out = {}
    for k in range(400):
        text = prose(k, 60)
        if k % 4 == 0:
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grobz", "snarkle", "fibbet"]))
            text = " ".join(words)
        out[k] = text
    return out


def test_held_out_accuracy_and_repeatability(spark):
    texts = corpus()
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in texts] + [(1, None)], "doc_id long, toxic int")
    learn = F.col("doc_id") % 5 != 0
    model = toxicity.fit(docs, labels, learn)
    again = toxicity.fit(docs.repartition(7), labels, learn)
    assert (model.slots == again.slots).all() and np.allclose(model.weights, again.weights)
    assert 0 < len(model.slots) < 5000
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in texts if k % 5 == 0]
    assert np.mean([(scores[k] >= 0.5) == (k % 4 == 0) for k in held]) > 0.95


def test_odd_texts_get_a_score(spark):
    none = toxicity.fit(documents(spark, odd_texts()), spark.createDataFrame([], "doc_id long, toxic int"))
    assert len(none.slots) == 0
    rows = list(odd_texts().items()) + [(5, odd_texts()[5]), (None, "x")]
    got = toxicity.score(documents(spark, rows), none).collect()
    assert len(got) == len(rows) and all(0 < r.score < 0.5 for r in got)
    assert toxicity.score(empty(spark), none).count() == 0


def test_slots_are_distinct_and_stay_within_a_text():
    from watchspan.llm.arrays import flat
    import pyarrow as pa

    one = toxicity.slots_of(*flat(pa.array(["Red fox. red FOX"])))
    two = toxicity.slots_of(*flat(pa.array(["red fox", None, "red fox red fox"])))
    assert set(one[1]) == set(two[1][two[0] == 2])
    assert len(set(two[1][two[0] == 0])) == 5 and not (two[0] == 1).any()


def test_long_texts_are_learned_whole(spark, monkeypatch):
    """A model learned for each word of a toxic text with far more than 4,000 features, none left out."""
    texts = {0: " ".join(f"bad{k}" for k in range(3000)), 1: "good words only", 2: ""}
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    weighed = lambda rows, labels: ((np.bincount(np.concatenate(rows), minlength=1 << toxicity.BITS) > 0).astype(float), 0.0)
    monkeypatch.setattr(toxicity, "ftrl", weighed)
    import pyarrow as pa
    from watchspan.llm.arrays import flat

    whole = toxicity.slots_of(*flat(pa.array(list(texts.values()))))[1]
    model = toxicity.fit(documents(spark, texts), labels)
    assert len(set(whole)) > 8000 and set(model.slots) == set(whole)
