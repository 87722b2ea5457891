"""Packing (operator 5): order-preserving dynamic programming over window cuts.

Documents are laid end to end in stored order. A window is a run of at most `window` tokens between two cut
candidates: a document's end (free), a sentence's end (a small penalty), or, where no sentence ends for long, a forced
cut (a larger one). With p the token positions of the candidates,

    f(j) = penalty(j) + min over i with p_j - p_i <= window of  f(i) + padding(p_j - p_i)

and padding(L) = 0 at a power of two, else window - L. The general term is (window - p_j) + min(f(i) + p_i), a sliding
minimum that a monotone queue serves in constant time; the powers of two are single look-ups. The state is one
segment of tokens per task: windows are emitted as soon as a segment is solved, and the last ones are solved again
together with the next documents.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import bound_batches, settle, table, texts_as_bytes

WINDOW = 4096
SENTENCE_PENALTY = 4
FORCED_PENALTY = 64
#: Without a sentence's end for so many tokens, a cut is allowed.
FORCED_EVERY = 512
SEGMENT_TOKENS = 1 << 18

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(pos: list[int], pen: list[int], window: int) -> list[int]:
    """Indices into pos of the chosen cuts, the first (0) and the last included. pos ascends strictly, gaps <= window."""
    n = len(pos)
    f, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(pos[0], 0)])  # (f + p, index), ascending in both
    at = {p: i for i, p in enumerate(pos)}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window and (1 << k) >= 64] or [window]
    look = at.get
    for j in range(1, n):
        p = pos[j]
        low = p - window
        while pos[queue[0][1]] < low:
            queue.popleft()
        key, i = queue[0]
        best = key + window - p
        if best:
            for k in powers:
                g = look(p - k)
                if g is not None and f[g] < best:
                    best, i = f[g], g
        best += pen[j]
        f[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, forced_every: int = FORCED_EVERY) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of the allowed cuts of a segment of n tokens; 0 and n are always among them."""
    own = np.unique(np.concatenate([[0, n], doc_ends, sentence_ends]))
    gaps = np.diff(own)
    wide = np.nonzero(gaps > forced_every)[0]
    forced = [np.arange(own[g] + forced_every, own[g + 1], forced_every) for g in wide]
    pos = np.unique(np.concatenate([own, *forced])) if forced else own
    pen = np.full(len(pos), FORCED_PENALTY)
    pen[np.isin(pos, sentence_ends, assume_unique=False)] = SENTENCE_PENALTY
    pen[np.isin(pos, doc_ends)] = 0
    pen[0] = pen[-1] = 0
    return pos, pen


def sentence_marks(tok: tokens.WordTokenizer) -> np.ndarray:
    """For each id, whether its token ends a sentence: punctuation that holds a full stop, question or exclamation mark."""
    marks = np.zeros(tok.library.get_vocab_size() + 1, bool)
    for word, i in tok.library.get_vocab().items():
        bare = word.removesuffix("</w>")
        if bare and bare[-1] in ".!?" and not any(c.isalnum() for c in bare):
            marks[i] = True
    return marks


class Packer:
    """Feeds on documents in order, gives pieces in order."""

    def __init__(self, marks: np.ndarray, first_sequence: int, window: int = WINDOW, segment: int = SEGMENT_TOKENS):
        self.marks, self.window, self.segment, self.sequence = marks, window, segment, first_sequence
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, all its tokens, tokens already emitted
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids)
        return self.solve(False) if self.held >= self.segment else []

    def solve(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        stream = np.concatenate([d[1][d[2] :] for d in self.docs])
        ends = np.cumsum([len(d[1]) - d[2] for d in self.docs])
        inside = np.nonzero(self.marks[np.minimum(stream, len(self.marks) - 1)])[0] + 1
        pos, pen = candidates(len(stream), ends, inside, min(FORCED_EVERY, self.window))
        cuts = pos[best_cuts(pos.tolist(), pen.tolist(), self.window)]
        if not last:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts[:1]
        done = int(cuts[-1])
        bounds = np.unique(np.concatenate([cuts, ends[ends < done], [done]]))
        out, d, seq = [], 0, -1
        starts = ends - np.array([len(x[1]) - x[2] for x in self.docs])
        which = np.searchsorted(ends, bounds[:-1], side="right")
        window_of = np.searchsorted(cuts, bounds[:-1], side="right") - 1
        for a, b, d, seq in zip(bounds[:-1].tolist(), bounds[1:].tolist(), which.tolist(), window_of.tolist()):
            doc_id, ids, emitted = self.docs[d]
            start = a - int(starts[d]) + emitted
            out.append((doc_id, start, b - a, zlib.crc32(stream[a:b].tobytes()), len(ids), self.sequence + seq, a - int(cuts[seq])))
        self.sequence += len(cuts) - 1
        keep = int(np.searchsorted(ends, done, side="right"))
        rest = self.docs[keep:]
        if rest and done > starts[keep]:
            doc_id, ids, emitted = rest[0]
            rest[0] = (doc_id, ids, emitted + done - int(starts[keep]))
        self.docs, self.held = rest, len(stream) - done
        return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row per piece. Nothing is shuffled: each input partition is packed by itself in stored order, so only its
    last windows can be short. A null text is empty and yields the end id alone; a null doc_id is carried as null;
    repeated rows are packed each; an empty table gives no row. Other columns of docs are not read."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle("tokens")
        tok = tokens.opened(tokenizer_path)
        packer = Packer(sentence_marks(tok), TaskContext.get().partitionId() << 40, window)
        names = [f.split()[0] for f in PIECES.split(", ")]
        end = np.array([end_id], "<u4").tobytes()

        def batch(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), tok.encode(texts_as_bytes(b.column("text")))):
                rows += packer.add(doc_id, np.frombuffer(raw + end, "<u4"))
            if rows:
                yield batch(rows)
        rows = packer.solve(True)
        if rows:
            yield batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens.default_path(), end_id=2)
