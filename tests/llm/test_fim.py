import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import documents, empty, odd_texts, prose

from watchspan.llm import fim
from watchspan.llm.arrays import flat

MARKED = {50: "has <P> inside", 51: "a <S>", 52: "<M>", 53: "<", 54: "<S", 55: "ends with <", 56: "P>x<", 57: "é" * 20_000, 58: "x" * 30_000, 59: "😀"}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    h = digest(f"1:{'' if doc_id is None else doc_id}")
    h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, digest(text), digest(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, digest(f"<S>{s}<P>{p}<M>{m}"), digest(text))
    return (doc_id, n, "psm", a, b - a, digest(f"<P>{p}<S>{s}<M>{m}"), digest(text))


def test_query_equals_plain_slicing(spark, tmp_path):
    shared = prose(900, 400)
    texts = [*odd_texts().items(), *MARKED.items(), *[(100 + k, prose(k, 5 * k) + shared + prose(k + 500, 3)) for k in range(60)], (None, prose(3, 50)), (100, prose(1, 40)), (100, prose(1, 40))]
    documents(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op11_fill_in_middle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain(*t) for t in texts), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_output_gives_back_the_text(spark):
    texts = [*odd_texts().items(), *MARKED.items()]
    done = fim.transform(documents(spark, texts), units="words", rate=100, spm_rate=50)
    rows = done.select("doc_id", "form", "prefix", "middle", "suffix", fim.restore(done.output, done.form).alias("again")).collect()
    for r in rows:
        text = dict(texts)[r.doc_id] or ""
        assert r.again == text
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == text
    assert fim.transform(empty(spark)).count() == 0


def places(text, units):
    """Bytes at which units begin, by patterns over the bytes."""
    patterns = {"code_points": rb"(?s)[^\x80-\xBF][\x80-\xBF]*", "lines": rb"[^\n]*\n|[^\n]+", "words": rb"\A[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"}
    return [m.start() for m in re.finditer(patterns[units], text.encode())]


@pytest.mark.parametrize("units", ["code_points", "words", "lines"])
def test_units_by_chunks_equal_a_walk_over_the_text(units, monkeypatch):
    monkeypatch.setattr(fim, "REMEMBER", 40)
    texts = [t or "" for t in [*odd_texts().values(), *MARKED.values()]] + [prose(7, 3000) + prose(8, 40), " x\n\ny z ", "a", "ä\n", prose(7, 3000)]
    data, offsets = flat(pa.array(texts))
    memory = fim.Summaries(units)
    for _ in range(2):  # the second time from memory
        found = fim.Units(data, offsets, memory)
        for row, (text, n) in enumerate(zip(texts, found.count().tolist())):
            expected = places(text, units)
            assert n == len(expected), (units, text[:40])
            for k in {0, n // 3, n // 2, max(n - 1, 0)} & set(range(n)):
                assert found.place(row, k) - offsets[row] == expected[k]
            assert found.place(row, n) == offsets[row + 1]


def test_chunks_of_a_shared_passage_are_the_same():
    shared = prose(1, 3000)
    texts = [prose(k, 20 * k + 3) + shared for k in range(5)]
    data, offsets = flat(pa.array(texts))
    edges = np.append(fim.chunk_starts(data, offsets), len(data))
    sizes = np.diff(edges)
    assert sizes.max() <= fim.MOST and set(offsets[:-1].tolist()) <= set(edges.tolist())
    chunks = [data[a:b].tobytes() for a, b in zip(edges, edges[1:])]
    assert len(set(chunks)) < len(chunks) / 3
    assert 200 < sizes.mean() < 1500


def test_draws_differ_between_documents():
    rng = random.Random(1)
    forms = [fim.draws(1, rng.randrange(10**9)) for _ in range(3000)]
    assert 0.85 < np.mean([h[2] % 100 < 90 for h in forms]) < 0.95
