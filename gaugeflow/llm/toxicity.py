"""Toxicity (operator 8): a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the presence of all its character n-grams (three to five code points of the lower-cased text),
hashed into 2^20 buckets. From labelled texts come r = log((a + pos) / |a + pos|) - log((a + neg) / |a + neg|) per bucket,
and a logistic regression with ridge penalty is fitted on x = r * presence; every bucket met in them has a weight. Scoring
is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, settle, table

BITS = 20
NGRAMS = (3, 4, 5)
PIECE_CHARS = 400_000
#: Bounds of the labelled sample that fits the model: rows, toxic and other, and the n-grams of each class's rows (the last
#: row may pass them). The rows with the least hashes are taken.
MAX_TOXIC, MAX_OTHER = 5_000, 10_000
MAX_NGRAMS = {1: 12_000_000, 0: 24_000_000}
#: Features of the sample that the fit reads at once.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each with a space before and after it, and the offsets that bound each."""
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    n = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    joined = " " + "  ".join(low.to_pylist()) + " "
    cp = np.frombuffer(joined.encode("utf-32-le"), "<u4").copy()
    cp[(cp >= 9) & (cp <= 13)] = 32
    return cp, np.concatenate([[0], np.cumsum(n)])


def grams(cp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, the bucket of the n-gram that starts at each position, those that cross texts included."""
    h = cp * np.uint32(0x9E3779B1)
    for n in range(2, max(NGRAMS) + 1):
        if len(cp) < n:
            return
        h = (h[: len(cp) - n + 1] ^ cp[n - 1 :]) * np.uint32(0x85EBCA6B)
        if n in NGRAMS:
            b = h ^ (h >> np.uint32(15))
            yield n, ((b * np.uint32(0xC2B2AE35) + np.uint32(n)) >> np.uint32(32 - BITS)).astype(np.intp)


def present(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct buckets of each text, in any order."""
    for part in slices(column):
        cp, offs = code_points(part)
        if len(part) == 1 and len(cp) > PIECE_CHARS:
            met = np.zeros(1 << BITS, bool)
            for i in range(0, len(cp), PIECE_CHARS):
                for _, b in grams(cp[i : i + PIECE_CHARS + max(NGRAMS) - 1]):
                    met[b] = True
            yield np.nonzero(met)[0]
            continue
        every = list(grams(cp))
        place, last = np.arange(len(NGRAMS) * int(np.diff(offs).max())), np.empty(1 << BITS, np.intp)
        for a, z in zip(offs[:-1], offs[1:]):
            b = np.concatenate([b[a : max(a, z - n + 1)] for n, b in every]) if every else np.zeros(0, np.intp)
            # of the places of one bucket a single one is the last written
            last[b] = place[: len(b)]
            yield b[last[b] == place[: len(b)]]


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of bounded length; one long text stands alone."""
    ends = np.cumsum(pc.utf8_length(pc.fill_null(column, "")).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE_CHARS, side="right")))
        yield column.slice(i, j - i)
        i = j


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this rest; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(True))


def fit(sample: DataFrame, priors: tuple[int, int], rounds: int = 100, ridge: float = 1e-4) -> Model:
    """sample: text, toxic (0 or 1), bounded as the constants say: its buckets come to the driver, 4 bytes a feature."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            found = pa.array([np.sort(k).astype(np.int32).tobytes() for k in present(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), found], ["toxic", "found"])

    got = sorted((bytes(r["found"]), r["toxic"]) for r in sample.repartition(16).mapInArrow(index, "toxic int, found binary").toLocalIterator())
    y = np.array([t for _, t in got], float)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    all1, all0 = priors
    prior = np.log((all1 + 0.5) / (all0 + 0.5))
    ends = np.cumsum([0, *(len(f) // 4 for f, _ in got)])
    col = np.frombuffer(b"".join(f for f, _ in got), np.int32)
    del got
    if not n1 or not n0 or not len(col):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(prior))
    met = np.bincount(col, minlength=1 << BITS) > 0
    buckets = np.nonzero(met)[0]
    col = (np.cumsum(met) - 1).astype(np.int32)[col]
    pos, neg = 1 + _by_feature(col, ends, y, len(buckets)), 1 + _by_feature(col, ends, 1 - y, len(buckets))
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    weight = np.where(y == 1, max(all1, 1) / n1, max(all0, 1) / n0)
    return Model(buckets, *logistic(col, ends, ratio, y, weight / weight.sum(), float(prior), rounds, ridge))


def _blocks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about BLOCK features each; one long row stands alone."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, side="right")) - 1)
        yield i, min(j, n)
        i = j


def _by_feature(col: np.ndarray, ends: np.ndarray, of_row: np.ndarray, n: int) -> np.ndarray:
    """Per feature of n, the sum of a value over the rows that hold it."""
    out = np.zeros(n)
    for i, j in _blocks(ends):
        out += np.bincount(col[ends[i] : ends[j]], np.repeat(of_row[i:j], np.diff(ends[i : j + 1])), minlength=n)
    return out


def _by_row(col: np.ndarray, ends: np.ndarray, of_feature: np.ndarray) -> np.ndarray:
    """Per row, the sum of a value over its features."""
    out = np.zeros(len(ends) - 1)
    for i, j in _blocks(ends):
        some = np.nonzero(np.diff(ends[i : j + 1]))[0]
        if len(some):
            out[i + some] = np.add.reduceat(of_feature[col[ends[i] : ends[j]]], ends[i + some] - ends[i])
    return out


def logistic(col, ends, ratio, y, weight, prior: float, rounds: int, ridge: float) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the weighted logistic loss over x = ratio * presence, with a ridge penalty. Returns
    the weight of a feature's presence, and the intercept."""
    v, top = np.ones(len(ratio)), 1.0
    for _ in range(10):  # the largest eigenvalue of the weighted second moments bounds the curvature
        v = ratio * _by_feature(col, ends, weight * _by_row(col, ends, ratio * v), len(ratio))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * (top + 1) * 1.1 + ridge)
    w, b, wv, bv = np.zeros(len(ratio)), prior, np.zeros(len(ratio)), prior
    for t in range(rounds):
        s = _by_row(col, ends, ratio * wv) + bv
        g = weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
        nw, nb = wv - step * (ratio * _by_feature(col, ends, g, len(ratio)) + ridge * wv), bv - step * g.sum()
        m = t / (t + 3)
        wv, bv, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w * ratio, float(b)


def score(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Adds score and predicted, under names that docs must not hold. Null and empty texts get the score
    of a text without any known n-gram."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    schema = docs.withColumns({score: F.lit(0.0), predicted: F.lit(0)}).schema
    fitted = (model.buckets, model.weights, model.intercept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        buckets, weights, intercept = fitted
        w = np.zeros(1 << BITS)
        w[buckets] = weights
        for batch in batches:
            s = np.array([w[b].sum() for b in present(batch.column("text"))], float) + intercept
            s = 1 / (1 + np.exp(-np.clip(s, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, score, predicted])

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> Model:
    """Fits on at most max_toxic + max_other labelled rows, of at most MAX_NGRAMS n-grams, whose id isn't held out; labels
    that are null or not 0 or 1 don't count. The sample's ids are a table of that proven size, so joining them moves no
    text. Of documents with one id the least text is learned, so repeated ids don't outgrow the bound."""
    spark = docs.sparkSession
    learn = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    n = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64("doc_id")
    part = lambda c, most: learn.where(F.col("toxic") == c).orderBy(h, "doc_id").limit(most)
    ids = part(1, max_toxic).unionByName(part(0, max_other))
    scratch = Scratch(spark)
    met = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id")
    sample = scratch.write(met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    # a text has at most one n-gram of each length a place, and no more features than there are buckets
    size = F.least(len(NGRAMS) * F.coalesce(F.char_length("text"), F.lit(0)).cast("long"), F.lit(1 << BITS))
    before = F.sum("size").over(Window.partitionBy("toxic").orderBy(h, "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    most = F.when(F.col("toxic") == 1, MAX_NGRAMS[1]).otherwise(MAX_NGRAMS[0])
    taken = sample.select("doc_id", "toxic", size.alias("size")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).select("doc_id", "toxic")
    model = fit(sample.join(F.broadcast(taken), ["doc_id", "toxic"]).select("text", "toxic"), (n.get(1, 0), n.get(0, 0)))
    scratch.clear()
    return model


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; repeated rows get equal scores. A table without labels
    of both classes gives every text the same score, the labels' share."""
    bound_batches(docs.sparkSession)
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
