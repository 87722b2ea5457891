"""MinHash near-duplicates (operator 3): ProbMinHash over weighted word shingles, banding, exact verification.

A text's weighted set is its five-word shingles with their counts. Each element arrives in a Poisson process whose rate
is its weight; every arrival falls on a random register, which keeps the earliest one. A text stops as soon as no
element can still come before the latest register. Two texts then agree on a register with the probability Jaccard
J_P = sum over common d of 1 / sum_e max(x_e / x_d, y_e / y_d). Bands of registers find candidates, and exact J_P (or
the plain Jaccard of the distinct shingles, if that is larger) decides. A text that repeats shingles has a second
signature of its distinct ones, with bands of its own: a passage that one copy repeats lowers J_P at will and leaves
the plain Jaccard as it is. Of a text without repeats both signatures are the same, so it meets either kind.

Texts with the same shingles and counts are one node from the start, so exact copies cost one row each and no pair.
The nodes of a bucket are first compared with the one among them that shares most buckets. Those that this leaves apart
are compared with the rest block by block, so no link between components is lost to a bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, free_name, mix64, pieces, settle, table, utf8
from .graph import link_stars, stars

WORDS = 5
THRESHOLD = 0.8
REGISTERS, ROWS = 100, 5
#: Candidates whose signatures, of counted and of distinct shingles, both agree on less than this share of registers (five
#: standard errors under the threshold) go.
LEAST_AGREED = 0.6
#: Bytes of texts hashed at once; working arrays take about 40 times as much.
PIECE_BYTES = 1 << 20
#: Candidate ids up to which a table is sent to every executor (24 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_P = np.uint64(0x100000001B3)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
HASH_BITS = 54


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


def shingles(column: pa.Array, n: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of bounded size: first row, and per distinct shingle (ascending by row and hash) its row within the
    slice, hash and count; last, the words of each row. Words are runs of letters and digits of the lower-cased text;
    a text of fewer than n words has one shingle, all its words."""
    raw, offs = utf8(pc.utf8_lower(column))
    for i, j in pieces(raw, offs, PIECE_BYTES):
        b = raw[offs[i] : offs[j]]
        ends = offs[i + 1 : j + 1] - offs[i]
        word = np.concatenate([[False], _IS_WORD[b], [False]])
        start = word[1:-1] & ~word[:-2]
        stop = word[1:-1] & ~word[2:]
        edge = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(b))]  # a text's end is a word's end
        start[edge] = word[1:-1][edge]
        stop[edge - 1] = word[1:-1][edge - 1]
        s, e = np.nonzero(start)[0], np.nonzero(stop)[0] + 1
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(b), _P)]))
        sums = np.zeros(len(b) + 1, np.uint64)
        sums[1:] = b
        sums[1:] += np.uint64(1)
        sums[1:] *= power[:-1]
        np.cumsum(sums, out=sums)
        del power
        back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(b), np.uint64(_inverse(int(_P))))]))
        w = mix64((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        del sums, back
        row = np.searchsorted(ends, s, side="right")
        words = np.bincount(row, minlength=j - i)
        c = np.uint64(0x9E3779B97F4A7C15)
        first = np.concatenate([[0], np.cumsum(words)])[:-1]
        hashes, rows = [], []
        if len(w) >= n:
            h = np.zeros(len(w) - n + 1, np.uint64)
            for k in range(n):
                h = h * c + w[k : len(w) - n + 1 + k]
            ok = row[: len(h)] == row[n - 1 :]
            hashes.append(mix64(h[ok])), rows.append(row[: len(h)][ok])
        for r in np.nonzero((words > 0) & (words < n))[0]:
            h = np.uint64(words[r])
            with np.errstate(over="ignore"):
                for x in w[first[r] : first[r] + words[r]]:
                    h = h * c + x
            hashes.append(mix64(np.array([h], np.uint64))), rows.append(np.array([r], np.int64))
        if hashes:
            at, h = np.concatenate(rows), np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)
            keys = np.sort(at.astype(np.uint64) << np.uint64(HASH_BITS) | h)  # a batch has at most 2^10 rows
            cut = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
            count = np.diff(np.concatenate([cut, [len(keys)]]))
            keys = keys[cut]
            yield i, (keys >> np.uint64(HASH_BITS)).astype(np.int64), keys & np.uint64((1 << HASH_BITS) - 1), count, words
        else:
            z = np.zeros(0, np.int64)
            yield i, z, z.astype(np.uint64), z, words


def digests(rows: int, at: np.ndarray, h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """16 bytes a row: sums of two mixes over its distinct shingles with their counts."""
    out = np.zeros((rows, 2), np.uint64)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x27BB2EE687B0B0FD)):
        np.add.at(out[:, k], at, mix64(mix64(h + np.uint64(salt)) + count.astype(np.uint64)))
    return out


def prob_minhash(rows: int, at: np.ndarray, h: np.ndarray, weight: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures (rows x m) of the elements that came first on each register; rows without elements stay 0."""
    best = np.full(rows * m, np.inf)
    sig = np.zeros(rows * m, np.uint32)
    x = np.zeros(len(h))
    label = (mix64(h) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    state = h.astype(np.uint64)
    inv = 1.0 / weight
    step = 0
    while len(h):
        step += 1
        r = mix64(state + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        x = x - np.log(((r >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) * inv
        slot = at * m + (mix64(r ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        better = x < best[slot]
        if better.any():
            s, v = slot[better], x[better]
            np.minimum.at(best, s, v)
            won = best[s] == v
            sig[s[won]] = label[better][won]
        bound = best.reshape(rows, m).max(1)
        go = x < bound[at]
        if not go.all():
            at, h, x, label, state, inv = at[go], h[go], x[go], label[go], state[go], inv[go]
    return sig.reshape(rows, m)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    out = []
    for k in range(sig.shape[1] // rows):
        key = np.full(len(sig), k + 1, np.uint64)
        for c in sig[:, k * rows : (k + 1) * rows].T:
            key = mix64(key ^ c.astype(np.uint64)) + c.astype(np.uint64)
        out.append(mix64(key))
    return np.stack(out, 1).view(np.int64)


def signatures(rows: int, at: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (rows x REGISTERS) of the counted and of the distinct shingles; equal in a row that repeats none."""
    sig = prob_minhash(rows, at, h, count.astype(float))
    again = np.zeros(rows, bool)
    again[at[count > 1]] = True
    plain = sig.copy()
    if again.any():
        some = again[at]
        place = np.cumsum(again) - 1
        plain[again] = prob_minhash(int(again.sum()), place[at[some]], h[some], np.ones(int(some.sum())))
    return sig, plain


def packed(sig: np.ndarray, plain: np.ndarray) -> list[bytes]:
    """Both signatures of each row, one after the other; once where they are equal."""
    return [x.tobytes() if (x == y).all() else x.tobytes() + y.tobytes() for x, y in zip(sig, plain)]


def unpacked(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(x if len(x) > 4 * REGISTERS else x + x for x in column), np.uint32).reshape(len(column), 2, REGISTERS)
    return both[:, 0], both[:, 1]


def agreement(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Share of the registers on which rows agree, of the two kinds the larger."""
    return np.maximum(*((x == y).mean(1) for x, y in zip(a, b)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Exact probability Jaccard and plain Jaccard of two weighted sets (ascending hashes, counts). O(n log n): the sum
    over e of max(x_e / x_d, y_e / y_d) splits at the ratio x_d / y_d."""
    ids = np.union1d(a[0], b[0])
    x, y = np.zeros(len(ids)), np.zeros(len(ids))
    x[np.searchsorted(ids, a[0])] = a[1]
    y[np.searchsorted(ids, b[0])] = b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0, 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    rs, xs, ys = ratio[order], x[order], y[order]
    below_y = np.concatenate([[0.0], np.cumsum(ys)])  # where x_e / y_e <= x_d / y_d, y_e / y_d is the larger
    above_x = xs.sum() - np.concatenate([[0.0], np.cumsum(xs)])
    cut = np.searchsorted(rs, ratio[both], side="right")
    jp = float((1 / (above_x[cut] / x[both] + below_y[cut] / y[both])).sum())
    return jp, float(both.sum() / len(ids))


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    if common >= threshold * (len(a[0]) + len(b[0]) - common) - 1e-9:
        return True
    # without repeated shingles both measures are one
    return bool(common and (a[1].max() > 1 or b[1].max() > 1) and similarity(a, b)[0] >= threshold - 1e-12)


def _sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingle hashes, ascending, and counts of each text; texts may be more than a batch has."""
    out = []
    for i in range(0, len(column), 1024):
        for _, at, h, count, words in shingles(column.slice(i, 1024)):
            cut = np.searchsorted(at, np.arange(len(words) + 1))
            out += [(h[x:y], count[x:y].astype(float)) for x, y in zip(cut, cut[1:])]
    return out


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, node (null where the text has no word), sig, bands."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            ids = b.column("doc_id")
            for i, at, h, count, words in shingles(b.column("text")):
                n = len(words)
                sig, plain = signatures(n, at, h, count)
                keys, node = [np.unique(x) for x in np.concatenate([bands(sig), bands(plain)], 1)], digests(n, at, h, count)
                some = words > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, n),
                        pa.array([x.tobytes() if ok else None for x, ok in zip(node, some)], pa.binary()),
                        pa.array([x if ok else None for x, ok in zip(packed(sig, plain), some)], pa.binary()),
                        pa.array([x if ok else None for x, ok in zip(keys, some)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "node", "sig", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node binary, sig binary, bands array<long>")


def _texts(docs: DataFrame, reps: DataFrame, small: bool) -> DataFrame:
    """node, text of the representatives. Where ids repeat, the text whose shingles are the node's is taken."""
    wanted = reps.select(F.col("doc_id").alias("rep"), "node")
    j = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted) if small else wanted, F.expr("doc_id <=> rep")).select("node", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            for i, at, h, count, words in shingles(b.column("text")):
                own = digests(len(words), at, h, count)
                ok = pa.array([x.tobytes() == y for x, y in zip(own, b.column("node").slice(i, len(words)).to_pylist())], pa.bool_())
                yield b.slice(i, len(words)).filter(ok)

    return j.mapInArrow(same, "node binary, text string").dropDuplicates(["node"])


def _score(nodes: DataFrame, threshold: float):
    """Decides each spoke: signatures first, then the whole sets. nodes: node, sig, text."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            s, t = (unpacked(b.column(c).to_pylist()) for c in ("sl", "sn"))
            near = agreement(s, t) >= LEAST_AGREED if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column("lead"), b.column("node"), pa.array(near), b.column("size")], ["lead", "node", "near", "size"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            yield b.select(["lead", "node"]).append_column("linked", pa.array([similar(x, y, threshold) for x, y in zip(_sets(b.column("tl")), _sets(b.column("tn")))], pa.bool_()))

    side = lambda df, a, **cols: df.join(nodes.select(F.col("node").alias(a), *(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in cols.items())), a)

    def score(spokes: DataFrame, scratch: Scratch) -> DataFrame:
        met = side(side(spokes, "node", sn="sig", size=F.octet_length("text")), "lead", sl="sig").select("lead", "node", "sl", "sn", "size")
        met = scratch.write(met.mapInArrow(agree, "lead binary, node binary, near boolean, size int"), "met")
        linked = side(side(met.where("near").select("lead", "node"), "node", tn="text"), "lead", tl="text").select("lead", "node", "tl", "tn").mapInArrow(exact, "lead binary, node binary, linked boolean").where("linked")
        return met.join(linked, ["lead", "node"], "left").select("lead", "node", F.lit(0.0).alias("sim"), F.coalesce("linked", F.lit(False)).alias("linked"), "size")

    return score


def _blocks(nodes: DataFrame, threshold: float):
    """Decides the pairs of two blocks of a star within one row, so that pairs that fail are never rows: common shingles
    of one node with all others are counted at once. Links that connect nothing new are left out."""

    def links(flat: pa.StructArray) -> Iterator[tuple[bytes, bytes]]:
        names, c = np.unique(np.array(flat.field("c").to_pylist(), object), return_inverse=True)
        node = np.unique(np.array(flat.field("node").to_pylist(), object), return_inverse=True)[1]
        left, right = (np.nonzero(flat.field(k).to_numpy(zero_copy_only=False))[0] for k in ("left", "right"))
        open_ = flat.field("open").to_numpy(zero_copy_only=False)
        sig, plain = unpacked(flat.field("sig").to_pylist())
        sets = _sets(flat.field("text"))
        size = np.array([len(h) for h, _ in sets])
        again = np.array([n.max() > 1 for _, n in sets])
        ids, at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
        from_ = np.concatenate([[0], np.cumsum(size)])
        other = np.concatenate([at[from_[k] : from_[k + 1]] for k in right]) if len(right) else at[:0]
        starts = np.concatenate([[0], np.cumsum(size[right])])[:-1]
        mark = np.zeros(len(ids), np.int64)
        root = np.arange(len(names))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = int(root[k])
            return k

        for i in left.tolist():
            own = at[from_[i] : from_[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[other], starts)
            mark[own] = 0
            fresh = (c[right] != c[i]) & ((node[i] < node[right]) | ~open_[right])
            linked = fresh & (common >= threshold * (size[i] + size[right] - common) - 1e-9)
            # without repeated shingles both measures are one
            for k in np.nonzero(fresh & ~linked & (common > 0) & (again[i] | again[right]) & ((sig[right] == sig[i]).mean(1) >= LEAST_AGREED))[0].tolist():
                linked[k] = top(int(c[i])) != top(int(c[right[k]])) and similarity(sets[i], sets[right[k]])[0] >= threshold - 1e-12
            for k in np.unique(c[right[linked]]).tolist():
                a, b = top(int(c[i])), top(k)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    yield names[a], names[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            out = [e for m in b.column("m") for e in links(m.values)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.binary()), pa.array([e[1] for e in out], pa.binary())], ["a", "b"])

    def blocks(dealt: DataFrame) -> DataFrame:
        full = dealt.join(nodes, "node").groupBy("lead", "i", "j").agg(F.collect_list(F.struct("left", "right", "open", "node", "c", "sig", "text")).alias("m"))
        return full.select("m").mapInArrow(run, "a binary, b binary")

    return blocks


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, Scratch]:
    """doc_id, node, class_id (the least id of the document's class), kept (whether its node stands for the class).

    One row per row of docs. A null or wordless text has a null node, links with nothing and is its own class, kept. A
    null id is carried as null and never names a class that has another id. Repeated rows share a class. An empty table
    gives no row. Columns of docs other than doc_id and text are not read.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(sign(docs), "signed")
    some = signed.where(F.col("node").isNotNull())
    spokes = stars(some.select("node", F.explode("bands").alias("key")).distinct(), scratch)
    who = scratch.write(spokes.select("node").unionByName(spokes.select(F.col("lead").alias("node"))).distinct(), "who")
    n = who.count()
    small = n <= BROADCAST_ROWS
    found = None
    if n:
        reps = scratch.write(some.join(F.broadcast(who) if small else who, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig")), "reps")
        nodes = scratch.write(_texts(docs, reps, small).join(reps.select("node", "sig"), "node"), "nodes")
        scratch.drop(who, reps)
        score = _score(nodes, threshold)
        found = link_stars(spokes, lambda s: score(s, scratch), _blocks(nodes, threshold), scratch)
        scratch.drop(nodes, spokes)
    rows = signed.select("doc_id", "node")
    if found is None:
        found = rows.select("node", F.col("node").alias("component")).limit(0)
    rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("top"))
    out = rows.join(least, "component", "left").select("doc_id", "node", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("node") == F.col("top"), F.lit(True)).alias("kept"))
    return out, scratch


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept: exactly one document of a class is kept, the one with the least id; of repeated ids in a
    class all rows say the same."""
    out, _ = near_duplicates(docs)
    return out.select("doc_id", "class_id", (F.col("kept") & F.expr("doc_id <=> class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one row of each class of near-duplicates; wordless texts all stay. Where ids
    are null or repeat, rows are told apart by their shingles."""
    out, scratch = near_duplicates(docs)
    out = scratch.write(out, "out")
    scratch.only(out)
    ids = out.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] == ids["d"]:
        gone = out.where(~F.expr("kept AND doc_id <=> class_id")).select("doc_id")
        return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(docs.columns)
    names, extra = docs.columns, free_name(docs.columns, "__node")
    schema = T.StructType([*docs.schema.fields, T.StructField(extra, T.BinaryType())])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            for i, at, h, count, words in shingles(b.column("text")):
                own = digests(len(words), at, h, count)
                part = b.slice(i, len(words))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() if w else None for x, w in zip(own, words)], pa.binary())], [*names, extra])

    tagged = scratch.write(docs.mapInArrow(tag, schema), "tagged")
    top = out.where(F.col("kept") & F.col("node").isNotNull()).select(F.col("node").alias(extra)).distinct()
    return tagged.where(F.col(extra).isNotNull()).join(top, extra, "left_semi").dropDuplicates([extra]).unionByName(tagged.where(F.col(extra).isNull())).select(names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
