"""Token ids of many texts at once, with a given tokenizer of the ``tokenizers`` library.

Texts are cut where any pre-tokenizer of this family cuts as well: before a single space or line feed between two
characters that are not white space, behind such a line feed, and between an ASCII letter and ASCII punctuation. Each
distinct piece is encoded once and remembered by the worker process, up to a number of pieces, and texts are put
together from the ids of their pieces. Pieces that are one word of Latin letters go to the tokenizer's model at once,
where a few probes show that this gives the same ids. Texts that may hold special tokens (``<|``) are encoded as they are.
"""

from __future__ import annotations

import os
import re
import sys
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

LETTER, MARK, SOLID = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SOLID[33:127] = True
#: First bytes of two-byte characters from U+00C0; none of them is white space.
LEAD = np.zeros(256, bool)
LEAD[0xC3:0xE0] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: every row, and every place at which it is safe to cut."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    if n > 1:
        solid, lead = SOLID[data], LEAD[data]
        before, behind = solid.copy(), solid | lead
        before[1:] |= lead[:-1]
        gap = np.zeros(n, bool)
        gap[1:-1] = before[:-2] & behind[2:]
        line = gap & (data == 10)
        begins[:-1] = line | (gap & (data == 32))
        begins[1:] |= line
        begins[1:-1] |= MARK[data[1:]] & LETTER[data[:-1]]
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        for row in np.unique(np.searchsorted(offsets, special, "right") - 1):
            begins[offsets[row]:offsets[row + 1]] = False
    begins[offsets] = True
    return np.flatnonzero(begins[:-1])


WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PROBES = (" the", "The", "Anbleth", " \u00c9toile", "stra\u00dfe", " \u00e4\u00f1\u00f8", "x")


def _byte_chars() -> dict[int, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


class Encoder:
    """``encode`` gives the ids of all texts of a batch in one array, and where each text begins in it."""

    def __init__(self, path: str, remember: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        self.between = next(iter(special.items()), None)
        self.chars = _byte_chars()
        self.styles = [style for style in (self._kept, self._lowered) if self._agrees(style)]
        self.remember = remember
        self.known: dict[bytes, int] = {}
        self.ids, self.begin = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _kept(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.chars)

    def _lowered(self, text: str) -> str:
        return text.strip(" ").lower().encode().decode("latin-1").translate(self.chars)

    def _agrees(self, style) -> bool:
        return all([t.id for t in self.tokenizer.model.tokenize(style(p))] == self.tokenizer.encode(p, add_special_tokens=False).ids for p in PROBES)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text in a row, and their numbers. What is no plain word is joined by a special token, which stands alone."""
        ids: list[list[int]] = [[]] * len(texts)
        run: list[int] = []
        decoded = [t.decode("utf-8", "replace") for t in texts]
        word, model = WORD.fullmatch, self.tokenizer.model.tokenize
        style = self.styles[0] if self.styles else None

        def close():
            if run:
                whole = self.tokenizer.encode_batch_fast([self.between[1].join([decoded[k] for k in run])], add_special_tokens=False)[0].ids
                at, begin = 0, 0
                ends = [k for k, i in enumerate(whole) if i == self.between[0]] + [len(whole)]
                for at, end in zip(run, ends):
                    ids[at] = whole[begin:end]
                    begin = end + 1
                run.clear()

        for k, text in enumerate(texts):
            if style and word(text):
                ids[k] = [t.id for t in model(style(decoded[k]))]
            elif self.between and text and b"<|" not in text:
                run.append(k)
                if len(run) == 2000:
                    close()
            else:
                ids[k] = self.tokenizer.encode(decoded[k], add_special_tokens=False).ids
        close()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

    def _slots(self, distinct: list[bytes]) -> np.ndarray:
        """Where the ids of each piece lie. New pieces are remembered while there is room, else only for this batch."""
        slots = np.array([self.known.get(x, -1) for x in distinct], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            texts = [distinct[k] for k in new]
            ids, sizes = self._encode(texts)
            have = len(self.known)
            begin = self.begin[have]
            ends = begin + np.cumsum(sizes)
            self.ids = _room(self.ids, ends[-1])
            self.ids[begin:ends[-1]] = ids
            self.begin = _room(self.begin, have + len(new) + 1)
            self.begin[have + 1:have + len(new) + 1] = ends
            slots[new] = np.arange(have, have + len(new))
            self.known.update(zip(texts[:max(0, self.remember - have)], range(have, have + len(new))))
        return slots

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = cuts(data, offsets)
        edges = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        slots = self._slots(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        begin, sizes = self.begin[slots], self.begin[slots + 1] - self.begin[slots]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(begin - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process and file. A module of that process keeps it, as task functions come anew with each task."""
    holder = sys.modules.setdefault("watchspan_llm_encoders", ModuleType("watchspan_llm_encoders"))
    if path not in vars(holder):
        setattr(holder, path, Encoder(path))
    return vars(holder)[path]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])
