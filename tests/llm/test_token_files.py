
import numpy as np
import public_tokenizers
import pytest
from llm_helpers import documents, empty, odd_texts, prose
from tokenizers import Tokenizer

import pyarrow as pa
import pyarrow.parquet  # noqa: F401
from watchspan.llm import idfile, packing
from watchspan.llm.arrays import flat
from watchspan.llm.tokens import Encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
WEIRD = ["", " ", "a  b", "x<|endoftext|>y z", "don't  stop\n\n ok", "tab\tx  y", "it's a'll 　z", "é́ x", "1 2,3.\n4", "end \n", "\nstart", "a \n b", "ABC'S 'Sx",
         "naïve ×÷ Ω ΑΣ σς", "  x a\u0085b", "İstanbul ß ſ", "a b c", "😀😀 ok", "<|", "word.word,word", "é è Étoile ñandú"]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_tokenizer(name):
    texts = WEIRD + [prose(k, 300) for k in range(20)]
    encoder, whole = Encoder(public_tokenizers.path(name), remember=200), Tokenizer.from_file(public_tokenizers.path(name))
    assert len(encoder.styles) == 1
    for _ in range(2):  # the second time from memory
        ids, first = encoder.encode(*flat(pa.array(texts + [None])))
        for k, text in enumerate(texts):
            assert ids[first[k]:first[k + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text
        assert first[-1] == first[-2]


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(3)
    counts = np.concatenate([[0], rng.integers(1, 50, 40), [0], [10**9, 10**8]])
    lengths = idfile.code_lengths(counts)
    used = counts > 0
    assert (lengths[~used] == 0).all() and sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
    assert int((counts * lengths).sum()) == huffman_cost(counts[used])
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    limited = idfile.code_lengths(np.array(fibonacci))
    assert limited.max() == 16 and sum(2.0 ** -int(x) for x in limited) == 1.0
    assert idfile.code_lengths(np.array([0, 5])).tolist() == [0, 1] and idfile.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]


def test_more_ids_than_sixteen_bits_hold():
    rng = np.random.default_rng(5)
    counts = np.concatenate([rng.integers(1, 9, 70_000), [0, 10**7]])
    lengths = idfile.code_lengths(counts)
    assert lengths.max() > 16 and sum(2.0 ** -int(x) for x in lengths if x) == 1.0
    ids = np.concatenate([rng.permutation(70_000), np.full(300, 70_001)])
    out, begin, inside = idfile.encode_bits(ids, np.array([0, len(ids)]), lengths, idfile.canonical(lengths))
    starts = inside[::256]
    sizes = np.minimum(256, len(ids) - 256 * np.arange(len(starts)))
    assert idfile.decode_blocks(out[:begin[-1]], starts, sizes, *idfile.decoding_table(lengths)).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        idfile.code_lengths(counts, 16)


def test_files_ascend_and_no_id_fills_a_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "PART_TOKENS", 400)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(7, "the same words again")] * 300 + [(7, prose(k, 5)) for k in range(60)] + [(k, prose(k, 9)) for k in range(-40, 60)]
    idfile.write_ids(documents(spark, rows).repartition(6), path, 2, f"{tmp_path}/files", f"{tmp_path}/scratch")
    files = sorted((tmp_path / "files" / "docs").glob("part-*.parquet"))
    read = [pa.parquet.read_table(f, columns=["part", "before", "doc_id", "n_tokens"]).to_pylist() for f in files]
    order = [r["doc_id"] for own in read for r in own]
    assert order == sorted(k for k, _ in rows)
    assert [r["part"] for own in read for r in own] == sorted(r["part"] for own in read for r in own)
    assert max(sum(r["n_tokens"] for r in own) for own in read) < 1600 and sum(any(r["doc_id"] == 7 for r in own) for own in read) > 2
    got = idfile.with_starts(idfile.read_ids(spark, f"{tmp_path}/files")).orderBy("start").collect()
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert [r.doc_id for r in got] == order


def huffman_cost(counts):
    import heapq

    heap, cost = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


def test_bits_round_trip():
    rng = np.random.default_rng(4)
    for counts in ([0, 5, 1, 1000, 0, 257], [1], [0, 0]):
        first = np.concatenate([[0], np.cumsum(counts)])
        ids = (rng.pareto(1, first[-1]) * 3).astype(np.int64) % 5000
        lengths = idfile.code_lengths(np.bincount(ids, minlength=5000))
        out, begin, inside = idfile.encode_bits(ids, first, lengths, idfile.canonical(lengths))
        table = idfile.decoding_table(lengths)
        got = idfile.decode_blocks(out[:begin[-1]], begin[:-1] * 8, np.array(counts), *table)
        assert got.tolist() == ids.tolist()
        assert all(inside[a] == 0 for a, n in zip(first, counts) if n)


def test_files_hold_every_document_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "PART_TOKENS", 5000)
    rows = list(odd_texts().items()) + [(5, odd_texts()[5]), (None, "x y"), (30, "<|endoftext|>")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    ids = {k: np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for k, t in rows}
    idfile.write_ids(documents(spark, rows), path, 2, f"{tmp_path}/files", f"{tmp_path}/scratch")
    got = idfile.with_starts(idfile.read_ids(spark, f"{tmp_path}/files")).collect()
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and bytes(r.ids) == ids[r.doc_id].tobytes() and r.n_tokens == len(ids[r.doc_id])
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [None, *sorted(k for k, _ in rows if k is not None)]
    assert len({r.part for r in got}) > 1
    idfile.write_ids(empty(spark), path, 2, f"{tmp_path}/none", f"{tmp_path}/scratch2")
    assert idfile.with_starts(idfile.read_ids(spark, f"{tmp_path}/none")).count() == 0


def test_packing_is_complete_tight_and_bounded(spark):
    rows = [(k, prose(k, 30 + 13 * k % 700)) for k in range(150)] + list(odd_texts().items()) + [(5, odd_texts()[5]), (None, "x")]
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    size = 1000
    got = packing.pack_tokens(documents(spark, rows).repartition(5), path, 1, size=size, open_bins=4).collect()
    want = []
    for k, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(k is None, k or 0, at // size, at, ids[at:at + size].tobytes()) for at in range(0, len(ids), size)]
    assert sorted(want) == sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, bytes(r.ids)) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        upto = 0
        for offset, length in sorted(own):
            assert offset == upto
            upto += length
        assert upto <= size
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.15 * -(-total // size)
    assert packing.pack_tokens(empty(spark), path, 1).count() == 0


def test_best_fit_and_fullest_first():
    bins = packing.BestFit(10, 2)
    assert bins.add(6, "a") is None and bins.add(7, "b") is None
    assert bins.add(3, "c") == [(0, "b"), (7, "c")]  # the tightest fit, now full
    assert bins.add(8, "d") is None
    assert bins.add(5, "e") == [(0, "d")]  # no room: the fullest closes
    assert bins.add(10, "f") == [(0, "f")]
    assert sorted(x[0][1] for x in bins.rest()) == ["a", "e"]
