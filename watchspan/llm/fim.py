"""Fill-in-the-middle: each text is cut into prefix, middle and suffix at two units, found by memoized chunks.

A rolling hash over 16 bytes cuts texts into chunks at places that depend on the content alone, so passages shared by many
texts give the same chunks. A worker process remembers the summary of every chunk it has met, by the chunk's own bytes
(a lookup compares them, so a summary never comes from other content): how many units begin behind its first byte, and the
kinds of its first and last bytes. Whether a unit begins at a byte depends on this byte and the one before, so the
summaries of neighbours combine into running counts of a text; these tell the chunk that holds a cut, and only that
chunk is read for the place itself. The memory is bounded by the number and bytes of chunks; beyond it chunks are counted anew.

Units are code points, words (a word with the white space behind it) or lines. The cuts and the form come from the digits of
sha256 over ``seed:doc_id``, so they do not depend on order or partitions. No shuffle is needed.

Defined cases: a null text is an empty one; an empty text, and one that holds a mark, stays plain; a null ``doc_id`` is the
empty text in the digest; repeated rows and ties each get their row; an empty table gives none; of other columns none is returned.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchspan.llm.arrays import SPACES, flat, pieces
from watchspan.llm.common import table, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WINDOW, LEAST, MEAN, MOST = 16, 64, 512, 8192
#: Chunks and bytes that a worker process remembers.
REMEMBER, REMEMBER_BYTES = 200_000, 64 << 20
_BASE = 0x9E3779B97F4A7C15

# For each kind of unit: the kind of a byte, and whether a unit begins at one kind behind another.
_CONTINUED = ((np.arange(256) & 0xC0) == 0x80).astype(np.uint8)
UNITS = {
    "code_points": (_CONTINUED, np.array([[1, 0], [1, 0]], bool)),  # 1: not the first byte of a character
    "words": (SPACES.astype(np.uint8), np.array([[0, 0], [1, 0]], bool)),
    "lines": ((np.arange(256) == 10).astype(np.uint8), np.array([[0, 0], [1, 1]], bool)),
}


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at every text, and behind bytes whose rolling hash has its top bits clear."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    power = np.array([pow(_BASE, WINDOW - 1 - k, 1 << 64) for k in range(WINDOW)], np.uint64)
    rolled = np.zeros(max(n - WINDOW + 1, 0), np.uint64)
    for k in range(WINDOW if len(rolled) else 0):
        rolled += data[k:k + len(rolled)].astype(np.uint64) * power[k]
    places = np.flatnonzero((rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD) < np.uint64((1 << 64) // (MEAN - LEAST))) + WINDOW
    out = []
    row = np.searchsorted(offsets, places, "right") - 1
    edges = np.searchsorted(row, np.arange(len(offsets)))
    for k in range(len(offsets) - 1):
        at, end = int(offsets[k]), int(offsets[k + 1])
        if at == end:
            continue
        out.append(at)
        for place in [*places[edges[k]:edges[k + 1]].tolist(), end]:
            while place - at > MOST:  # a long stretch without a place is cut by length
                at += MOST
                out.append(at)
            if LEAST <= place - at and place < end:
                at = place
                out.append(at)
    return np.array(out, np.int64)


class Summaries:
    """Summaries of chunks by content: units that begin behind the first byte, kinds of the first and the last byte."""

    def __init__(self, units: str):
        self.kind, self.begins = UNITS[units]
        self.known: dict[bytes, tuple[int, int, int]] = {}
        self.bytes = 0

    def _new(self, chunk: bytes) -> tuple[int, int, int]:
        kinds = self.kind[np.frombuffer(chunk, np.uint8)]
        found = int(np.count_nonzero(self.begins[kinds[:-1], kinds[1:]])), int(kinds[0]), int(kinds[-1])
        if len(self.known) < REMEMBER and self.bytes + len(chunk) <= REMEMBER_BYTES:
            self.known[chunk] = found
            self.bytes += len(chunk)
        return found

    def of(self, chunks: list[bytes]) -> np.ndarray:
        get = self.known.get
        return np.array([get(c) or self._new(c) for c in chunks], np.int64).reshape(-1, 3)

    def places(self, data: np.ndarray) -> np.ndarray:
        """Where units begin behind the first byte."""
        kinds = self.kind[data]
        return np.flatnonzero(self.begins[kinds[:-1], kinds[1:]]) + 1


def summaries_of(units: str) -> Summaries:
    """One memory per worker process and kind of unit, kept by a module of that process."""
    holder = sys.modules.setdefault("watchspan_llm_summaries", ModuleType("watchspan_llm_summaries"))
    if units not in vars(holder):
        setattr(holder, units, Summaries(units))
    return vars(holder)[units]


class Units:
    """The units of a batch of texts, counted and found by chunks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, memory: Summaries):
        self.data, self.offsets, self.memory = data, offsets, memory
        self.starts = chunk_starts(data, offsets)
        edges = np.append(self.starts, len(data))
        cells = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        inner, first, last = memory.of(cells.dictionary.to_pylist())[cells.indices.to_numpy()].T
        # A unit begins at the first byte of a text; at that of another chunk the last byte before decides.
        self.opens = np.ones(len(self.starts), bool)
        self.opens[1:] = memory.begins[last[:-1], first[1:]]
        self.chunk_of_row = np.searchsorted(self.starts, offsets)
        self.opens[self.chunk_of_row[:-1][np.diff(offsets) > 0]] = True
        self.upto = np.concatenate([[0], np.cumsum(inner + self.opens)])

    def count(self) -> np.ndarray:
        return np.diff(self.upto[self.chunk_of_row])

    def place(self, row: int, unit: int) -> int:
        """The byte at which ``unit`` of this text begins, or the text's end."""
        begin, end = int(self.chunk_of_row[row]), int(self.chunk_of_row[row + 1])
        want = int(self.upto[begin]) + unit
        if want >= self.upto[end]:
            return int(self.offsets[row + 1])
        chunk = int(np.searchsorted(self.upto[begin:end + 1], want, "right")) - 1 + begin
        at, stop = int(self.starts[chunk]), int(self.starts[chunk + 1]) if chunk + 1 < len(self.starts) else len(self.data)
        rest = want - int(self.upto[chunk]) - int(self.opens[chunk])
        return at if rest < 0 else at + int(self.memory.places(self.data[at:stop])[rest])


def draws(seed: int, doc_id) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def transform(docs: DataFrame, units: str = "code_points", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output): ``n`` counts units; the three parts are null where the form is plain.

    ``rate`` percent of the texts are cut, ``spm_rate`` percent of these with the suffix in front.
    """
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, n long, form string, prefix string, middle string, suffix string, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = summaries_of(units)
        for batch in pieces(batches):
            data, offsets = flat(batch.column("text"))
            found = Units(data, offsets, memory)
            rows = []
            for row, (n, doc_id) in enumerate(zip(found.count().tolist(), batch.column("doc_id").to_pylist())):
                text = data[offsets[row]:offsets[row + 1]].tobytes()
                h1, h2, h3, h4 = draws(seed, doc_id)
                if not text or h3 % 100 >= rate or any(m in text for m in marks):
                    rows.append((n, "plain", None, None, None, text))
                    continue
                a, b = (found.place(row, k) - int(offsets[row]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h4 % 100 < spm_rate:
                    rows.append((n, "spm", prefix, middle, suffix, marks[1] + suffix + marks[0] + prefix + marks[2] + middle))
                else:
                    rows.append((n, "psm", prefix, middle, suffix, marks[0] + prefix + marks[1] + suffix + marks[2] + middle))
            n, *texts = zip(*rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([t if t is None or isinstance(t, str) else t.decode() for t in c], pa.string()) for c in texts)],
                                  names=["doc_id", "n", "form", "prefix", "middle", "suffix", "output"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text again. It holds no mark itself, so the marks part its three pieces."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return done.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
numbers AS (
  SELECT doc_id, text, n, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS h1, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS h2,
         ('0x' || substr(d, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS h4 FROM drawn),
formed AS (
  SELECT doc_id, text, n, least(h1, h2) AS a, greatest(h1, h2) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
cut AS (
  SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n - b) AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
