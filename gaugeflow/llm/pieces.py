"""SentencePiece encoding and decoding (operator 10): distinct sampled segmentations by Gumbel top-k without replacement.

The lattice of a text has an edge for every vocabulary piece (and a byte fallback for a character without one). A
segmentation's weight is the product of its pieces' unigram probabilities, which follow Zipf's law in the vocabulary's
rank. A* search goes over perturbed prefixes: the exact log-mass of all completions is the bound, a prefix's perturbed
value is a Gumbel variable at that mass truncated at its parent's, and the k leaves popped first are a sample without
replacement in the order of their perturbed values. The value kappa of the best prefix left gives each sample its
inclusion score, log(1 - exp(-exp(log p - kappa))).

No piece crosses the start of a space run or a line break, so a text's lattice is the chain of its chunks' lattices.
Those are built once for each distinct chunk of a batch, and the descent below a popped prefix, which is plain ancestral
sampling, runs for all chunks of a batch at once. All draws are hashes of the row key, so a task that runs again gives
the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, mix64, settle, table, texts_as_bytes

SPACE = "▁"
TOP_K = 2
PIECE_BYTES = 4 << 20
CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Prefixes whose log-mass lies so far below the whole can't come before kappa but with probability exp(LEAST_MASS).
LEAST_MASS = -80.0
#: Virtual piece ids from here on stand for a character's bytes.
FALLBACK = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)
#: Spreads hashes that differ in their last characters only over the table.
_MIX = 0xD6E8FEB86659FD93
_SLOTS = 1 << 20

OUT = "doc_id long, rank int, ids array<int>, n_ids long, ids_crc32 long, log_prob double, log_inclusion double, decoded_crc32 long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash(points: np.ndarray) -> int:
    h = 0
    for c in points.tolist():
        h = (h * int(_P) + c + 1) & (1 << 64) - 1
    return h


class Vocabulary:
    """Pieces of a model with their log-probabilities, and a hash table of all their prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        text, self.raw, self.byte_id = {}, [b""] * self.size, np.zeros(256, np.int64)
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text[p] = i
                self.raw[i] = p.replace(SPACE, " ").encode()
        self.bytes = pa.array(self.raw, pa.large_binary())
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in text):
            raise ValueError("a piece crosses a chunk's edge")
        rank = np.arange(self.size) + 10.0
        self.logp = -np.log(rank) - np.log((1 / rank).sum())
        self.longest = max(map(len, text))
        found: dict[int, int] = {}
        for p, i in text.items():
            points = np.array([ord(c) for c in p])
            for n in range(1, len(p) + 1):
                found.setdefault(_hash(points[:n]), -1)
            found[_hash(points)] = i
        self.keys, self.ids = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -2, np.int32)
        for h, i in found.items():
            at = (h * _MIX & (1 << 64) - 1) >> 44
            while self.ids[at] != -2:
                at = (at + 1) % _SLOTS
            self.keys[at], self.ids[at] = h, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for a mere prefix, -2 for neither."""
        at = (h * np.uint64(_MIX) >> np.uint64(44)).astype(np.int64)
        out = self.ids[at]
        miss = np.nonzero((out != -2) & (self.keys[at] != h))[0]
        while len(miss):
            at[miss] = (at[miss] + 1) % _SLOTS
            out[miss] = self.ids[at[miss]]
            miss = miss[(out[miss] != -2) & (self.keys[at[miss]] != h[miss])]
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """Lattices of distinct chunks. Edges of a position are neighbours; positions are numbered through all chunks."""

    def __init__(self, vocab: Vocabulary, chunks: list[str]):
        length = np.array([len(c) for c in chunks], np.int64)
        self.start = np.cumsum(length) - length
        cp = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        n = len(cp)
        left = np.repeat(self.start + length, length) - np.arange(n)
        point = cp.astype(np.uint64) + np.uint64(1)
        at, h = np.arange(n), np.zeros(n, np.uint64)
        hits: list[tuple[np.ndarray, np.ndarray]] = []  # of each size, the positions of pieces and the pieces
        count = np.ones(n, np.int64)
        for size in range(1, vocab.longest + 1):
            h = h * _P + point[at + size - 1]
            got = vocab.find(h)
            if size == 1:
                hits.append((at, np.where(got >= 0, got, FALLBACK + cp.astype(np.int32))))
            else:
                hit = np.nonzero(got >= 0)[0]
                hits.append((at[hit], got[hit]))
                count[hits[-1][0]] += 1
            go = np.nonzero((got != -2) & (left[at] > size))[0]
            at, h = at[go], h[go]
            if not len(at):
                break
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        many = count[order]
        self.first = np.empty(n, np.int64)
        self.first[order] = np.cumsum(many) - many
        pos = np.repeat(order, many)
        self.id, self.size = np.empty(len(pos), np.int32), np.empty(len(pos), np.int32)
        free = self.first.copy()
        for size, (p, got) in enumerate(hits, 1):
            e = free[p]
            self.id[e], self.size[e] = got, size
            free[p] = e + 1
        del hits
        self.next = pos + self.size
        w = np.empty(len(pos))
        plain = self.id < FALLBACK
        w[plain] = vocab.logp[self.id[plain]]
        c = self.id[~plain] - FALLBACK
        w[~plain] = (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)) * vocab.logp[-1]
        self.count = count
        z = np.zeros(n + 1)
        tail = left[pos] == self.size
        reach = np.bincount(left, minlength=int(left.max(initial=0)) + 1)
        ends = np.cumsum(reach)
        for d in range(1, len(reach)):
            p = order[ends[d - 1] : ends[d]]
            if not len(p):
                continue
            a, b = self.first[p[0]], self.first[p[-1]] + count[p[-1]]
            x = w[a:b] + np.where(tail[a:b], 0.0, z[self.next[a:b]])
            cut = self.first[p] - a
            top = np.maximum.reduceat(x, cut)
            z[p] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, count[p])), cut))
        self.last = tail
        self.logp = w + np.where(tail, 0.0, z[self.next]) - z[pos]
        # sums within a position, so that a chunk's draws don't depend on the chunks beside it
        self.upto = np.exp(self.logp)
        for at in range(1, int(count.max(initial=0))):
            e = self.first[count > at] + at
            self.upto[e] += self.upto[e - 1]
        self.upto[self.first + count - 1] = 2.0  # the last edge takes what rounding leaves

    def sample(self, chunk: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one ancestral sample for each lane, in order, and the offsets that bound each lane's."""
        lane, cur = np.arange(len(chunk)), self.start[chunk]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        n = np.zeros(len(chunk), np.int64)
        while len(lane):
            u = (mix64(seed[lane] + np.uint64((len(steps) + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = self.first[cur]
            more = np.nonzero(self.upto[e] <= u)[0]
            while len(more):
                e[more] += 1
                more = more[self.upto[e[more]] <= u[more]]
            steps.append((lane, e))
            n[lane] += 1
            go = ~self.last[e]
            lane, cur = lane[go], self.next[e[go]]
        offs = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(offs[-1], np.int64)
        for k, (lane, e) in enumerate(steps):
            out[offs[lane] + k] = e
        return out, offs


def _uniform(seed: int, *parts: int) -> float:
    h, full = seed, (1 << 64) - 1
    for p in parts:
        h = h + (p + 1) * 0x9E3779B97F4A7C15 & full
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        h ^= h >> 31
    return ((h >> 11) + 0.5) * 2.0**-53


def _gumbels(rng_seed: int, branch: int, mass: np.ndarray, top: float) -> np.ndarray:
    """Gumbel variables at these log-masses, truncated at top."""
    h = mix64(np.uint64(rng_seed) + np.arange(1, len(mass) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64((branch + 1) * 0xE7037ED1A0B428DB & (1 << 64) - 1))
    g = mass - np.log(-np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53))
    return -np.logaddexp(-top, -g)


class Search:
    """Top-k of one text. runs: for each of k independent descents, the edges of the whole text and, per step, which chunk
    of the text it belongs to. A popped prefix takes its descent's edges for the chunks after the one it diverges in."""

    def __init__(self, lattice: Lattices, runs: list[tuple[np.ndarray, np.ndarray]], seed: int):
        self.lattice, self.runs, self.seed = lattice, runs, seed
        self.paths: list[np.ndarray] = []
        self.chunk_of: list[np.ndarray] = []
        self.values: list[float] = []
        self.logps: list[float] = []
        #: For each path the values of what branches off at each of its steps; edges that a step has given away.
        self.open: list[np.ndarray] = []
        self.taken: dict[tuple[int, int], set[int]] = {}
        self.front: list[int] = []

    def _add(self, path: np.ndarray, chunk_of: np.ndarray, value: float, front: int) -> None:
        logp = self.lattice.logp[path]
        run = np.cumsum(logp)
        near = int(np.searchsorted(-run, -LEAST_MASS)) + 1
        some = logp[:near]
        with np.errstate(divide="ignore", invalid="ignore"):
            mass = run[:near] - some + np.log(np.maximum(-np.expm1(some), 0.0))
            g = _gumbels(self.seed, len(self.paths), mass, value)
        g[: min(front, len(g))] = -np.inf
        g[(self.lattice_count(path[:near]) < 2) | ~np.isfinite(mass)] = -np.inf
        self.paths.append(path), self.chunk_of.append(chunk_of), self.values.append(value), self.open.append(g)
        self.logps.append(float(logp.sum()))

    def lattice_count(self, edges: np.ndarray) -> np.ndarray:
        return self.lattice.count[self.lattice.next[edges] - self.lattice.size[edges]]

    def _best(self) -> tuple[float, int, int]:
        best = (-np.inf, -1, -1)
        for s, g in enumerate(self.open):
            if len(g):
                t = int(g.argmax())
                if g[t] > best[0]:
                    best = (float(g[t]), s, t)
        return best

    def top(self, k: int) -> tuple[list[tuple[np.ndarray, float]], float]:
        """(edges, log-probability) of the samples in order, and kappa."""
        L = self.lattice
        self._add(*self.runs[0], -np.log(-np.log(_uniform(self.seed, 1))), 0)
        for j in range(1, k):
            value, s, t = self._best()
            if s < 0:
                break
            path, chunk_of = self.paths[s], self.chunk_of[s]
            at = int(L.next[path[t]] - L.size[path[t]])
            taken = self.taken.setdefault((s, t), {int(path[t])})
            free = [e for e in range(int(L.first[at]), int(L.first[at] + L.count[at])) if e not in taken]
            p = np.exp(L.logp[free])
            e = free[int(min(np.searchsorted(np.cumsum(p), _uniform(self.seed, 2, j) * p.sum(), side="right"), len(free) - 1))]
            taken.add(e)
            rest = [f for f in free if f != e]
            before = float(L.logp[path[:t]].sum())
            self.open[s][t] = -np.inf
            if rest:
                mass = before + float(np.log(np.exp(L.logp[rest]).sum()))
                self.open[s][t] = float(_gumbels(self.seed, 1000 + j, np.array([mass]), value)[0])
            here, new = int(chunk_of[t]), [e]
            while not L.last[new[-1]]:
                at = int(L.next[new[-1]])
                u, x = _uniform(self.seed, 3, j, len(new)), int(L.first[at])
                while L.upto[x] <= u:
                    x += 1
                new.append(x)
            run, run_chunk = self.runs[j]
            after = int(np.searchsorted(run_chunk, here, side="right"))
            self._add(np.concatenate([path[:t], new, run[after:]]), np.concatenate([chunk_of[:t], np.full(len(new), here), run_chunk[after:]]), value, t + 1)
        kappa = self._best()[0]
        return list(zip(self.paths, self.logps)), kappa


def decode(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of ids as UTF-8, without the space that encoding puts in front."""
    return b"".join(map(vocab.raw.__getitem__, ids.tolist())).removeprefix(b" ")


def decoded_crc32(vocab: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[int]:
    """crc32 of what decode returns for each run of ids; ends bound the runs, from 0. All are put together at once."""
    text = vocab.bytes.take(pa.array(ids))
    _, offs, data = text.buffers()
    at, buf = np.frombuffer(offs, np.int64)[ends].tolist(), memoryview(data) if data is not None else memoryview(b"")
    return [zlib.crc32(buf[a + (a < b and buf[a] == 32) : b]) for a, b in zip(at, at[1:])]


def piece_ids(vocab: Vocabulary, lattice: Lattices, path: np.ndarray) -> np.ndarray:
    ids = lattice.id[path]
    if ids.max(initial=0) < FALLBACK:
        return ids.astype("<u4")
    odd = np.nonzero(ids >= FALLBACK)[0]
    parts, last = [], 0
    cache_: dict[int, np.ndarray] = {}
    for i in odd.tolist():
        c = int(ids[i]) - FALLBACK
        if c not in cache_:
            cache_[c] = vocab.byte_id[list(chr(c).encode())]
        parts += [ids[last:i], cache_[c]]
        last = i + 1
    return np.concatenate([*parts, ids[last:]]).astype("<u4")


def sample_texts(vocab: Vocabulary, texts: list[bytes], seeds: np.ndarray, k: int) -> Iterator[list[tuple[np.ndarray, float, float]]]:
    """For each text its samples: ids, log-probability, log of the inclusion score."""
    words = [CHUNK.findall((SPACE + t.decode()).replace(" ", SPACE)) if t else [] for t in texts]
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    chunk = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
    lattice = Lattices(vocab, list(known))
    n = np.array([len(w) for w in words], np.int64)
    offs = np.concatenate([[0], np.cumsum(n)])
    within = np.arange(offs[-1]) - np.repeat(offs[:-1], n)
    base = np.repeat(seeds, n)
    sampled = []
    for j in range(k if len(chunk) else 0):
        edges, cut = lattice.sample(chunk, mix64(base + (within + 1).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(j * 0x2127599BF4325C37 & (1 << 64) - 1)))
        sampled.append((edges, cut, np.repeat(within, np.diff(cut))))
    for i in range(len(texts)):
        if not n[i]:
            yield [(np.zeros(0, "<u4"), 0.0, 0.0)]
            continue
        runs = [(e[c[offs[i]] : c[offs[i + 1]]], w[c[offs[i]] : c[offs[i + 1]]]) for e, c, w in sampled]
        found, kappa = Search(lattice, runs, int(seeds[i])).top(k)
        out = []
        for path, logp in found:
            x = logp - kappa
            log_q = 0.0 if kappa == -np.inf or x > 30 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else x
            out.append((piece_ids(vocab, lattice, path), logp, log_q))
        yield out


def encode_sampled(docs: DataFrame, path: str, k: int = TOP_K) -> DataFrame:
    """At most k rows per row of docs (fewer where a text has fewer segmentations), ranked by perturbed value from 0.

    ids is the segmentation; n_ids and ids_crc32 (little-endian unsigned 32-bit) sum it up, decoded_crc32 is that of the
    text decoded from it, which decode_ids returns. A null or empty text has one segmentation, without ids. Draws depend on doc_id and rank only, so repeated
    rows get equal samples; a null doc_id is carried as null. An empty table gives no row; other columns aren't read.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        vocab = vocabulary(path)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), texts_as_bytes(b.column("text"))
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= PIECE_BYTES):
                    size += len(texts[j])
                    j += 1
                seeds = mix64(np.array([0 if x is None else x for x in ids[i:j]], np.int64).astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
                rows, found = [], []
                for d, samples in zip(ids[i:j], sample_texts(vocab, texts[i:j], seeds, k)):
                    for r, (s, logp, log_q) in enumerate(samples):
                        rows.append((d, r, len(s), zlib.crc32(s), logp, log_q))
                        found.append(s)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                ends, every = np.cumsum([0, *map(len, found)]), np.concatenate(found).view(np.int32)
                cols.insert(2, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(every)))
                cols.append(pa.array(decoded_crc32(vocab, every, ends), pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in OUT.split(", ")])
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def decode_ids(encoded: DataFrame, path: str, column: str = "ids", out: str = "text") -> DataFrame:
    """Adds out, the text that a column of ids stands for; other columns are carried. No ids give an empty text, null
    ids a null one; bytes that are no UTF-8 become U+FFFD, and an id that the vocabulary doesn't have is an error."""
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        vocab = vocabulary(path)
        for b in batches:
            found = []
            for ids in b.column(column):
                if not ids.is_valid:
                    found.append(None)
                    continue
                x = np.array(ids.as_py(), np.int64)
                if len(x) and not 0 <= x.min() <= x.max() < vocab.size:
                    raise ValueError(f"no such piece among {x.min()}..{x.max()}")
                found.append(decode(vocab, x).decode(errors="replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segmentation whole: its ids, which decode_ids turns into text, and their digests."""
    return encode_sampled(table(spark, sf_dir, "documents"), default_path())
