"""Texts of an Arrow batch as flat arrays, so that work on words runs over all texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or one row where its text is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        upto, begin = np.cumsum(lengths, dtype=np.int64), 0
        while begin < batch.num_rows:
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (with the end of the last); a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def single_spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space: the bytes, where words begin and end in them, and the row of each word."""
    space = SPACES[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins = begins[:-1]
    after_word = np.zeros(len(data), bool)
    after_word[1:] = ~space[:-1]
    first = ~space & (~after_word | begins)
    last = np.zeros(len(data), bool)
    last[:-1] = ~space[:-1] & (space[1:] | begins[1:])
    if len(data):
        last[-1] = ~space[-1]
    keep = ~space | after_word
    place = np.cumsum(keep) - 1
    out = np.where(space, np.uint8(32), data)[keep]
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, "right") - 1
    return out, place[starts], place[np.flatnonzero(last)] + 1, row


#: Letters and digits of ASCII and all bytes of other characters; the rest parts words.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers))
    return out[0], out[1]


def mix(*parts) -> np.ndarray:
    """One 64-bit number for several, in order."""
    out = np.uint64(0x2545F4914F6CDD1D)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ np.asarray(p, np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            out = out ^ (out >> np.uint64(32))
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray, beginning: int | None = None, word: np.ndarray = WORD) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of each word (A-Z lower-cased) and its row; with ``beginning``, one of so many first bytes too.

    ``word`` says which bytes belong to words.

    Words are the values of polynomials in their bytes, taken from one running sum over the whole batch.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))[:2 + (beginning is not None)]
    inside = word[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:-1]
    last[:-1] &= ~inside[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * power, out=upto[1:])
    hashes = [mix((upto[stop] - upto[starts]) * inverse[starts]) for stop in (ends, *([np.minimum(ends, starts + beginning)] if beginning else []))]
    return hashes[0], np.searchsorted(offsets, starts, "right") - 1, *hashes[1:]


CODEC = "zstd"


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, their bytes by place, so that the zero ones on top cost nothing."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pa.Codec(CODEC, compression_level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def unpacked(blob: bytes, count: int) -> np.ndarray:
    planes = pa.Codec(CODEC).decompress(blob, decompressed_size=8 * count, asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)
