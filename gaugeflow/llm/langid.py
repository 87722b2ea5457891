"""Language identification (operator 9) with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector binds (multiplies) its
letters' vectors, each rotated by its place; a text's or a language's profile bundles (adds) the vectors of all its
n-grams. A text gets the language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, settle, table
from .toxicity import held_out

DIM = 1024
N = 3
LETTER_BITS = 18
BLOCK_DOCS = 128
BLOCK_CHARS = 400_000
#: n-grams whose vectors a worker keeps; others are bound anew.
MEMO_GRAMS = 40_000


@cache
def letter_ids() -> np.ndarray:
    """For each code point, the rank of its letter among all letters (from 1), 0 for what isn't a letter. Marks that
    follow a letter count as letters of their own."""
    is_letter = np.array([unicodedata.category(chr(c))[0] in "LM" if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
    return np.where(is_letter, np.cumsum(is_letter), 0).astype(np.int64)


@cache
def _ranked() -> np.ndarray:
    return np.nonzero(letter_ids())[0]


@cache
def letter_vector(letter: int, dim: int) -> np.ndarray:
    """The vector of the letter of this rank; rank 0 is the gap between words."""
    point = int(_ranked()[letter - 1]) if letter else 0
    return np.random.Generator(np.random.PCG64([point, dim, 9])).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)


def bind(code: int, dim: int) -> np.ndarray:
    out = np.ones(dim, np.int8)
    for place in range(N):
        letter = code >> (LETTER_BITS * (N - 1 - place)) & ((1 << LETTER_BITS) - 1)
        out *= np.roll(letter_vector(letter, dim), N - 1 - place)
    return out


class Grams:
    """Vectors of n-grams by code, kept while there is room."""

    def __init__(self, dim: int):
        self.dim, self.codes, self.rows = dim, np.zeros(0, np.int64), np.zeros((0, dim), np.int8)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """codes: distinct and ascending."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if not len(new):
            return self.rows[np.searchsorted(self.codes, codes)]
        made = np.stack([bind(int(c), self.dim) for c in new])
        every = np.concatenate([self.codes, new])
        order = np.argsort(every)
        every, rows = every[order], np.concatenate([self.rows, made])[order]
        if len(every) <= MEMO_GRAMS:
            self.codes, self.rows = every, rows
        return rows[np.searchsorted(every, codes)]


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the n-grams of each text, ascending, and each row's number of letters."""
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    n = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = letter_ids()[np.frombuffer("".join(low.to_pylist()).encode("utf-32-le"), "<u4")]
    row = np.repeat(np.arange(len(column), dtype=np.int64), n)
    letters = np.bincount(row[ids > 0], minlength=len(column))
    first = np.ones(len(ids), bool)
    first[1:] = row[1:] != row[:-1]
    keep = ids > 0
    keep[1:] |= (ids[:-1] > 0) & ~first[1:]  # one gap after each word
    ids, row = ids[keep], row[keep]
    code, ok = ids.copy(), np.ones(len(ids), bool)
    for k in range(1, N):
        code = code[:-1] << LETTER_BITS | ids[k:] if len(ids) > k else code[:0]
        ok = row[: len(code)] == row[k:] if len(code) else ok[:0]
    keys = np.sort((row[: len(code)] << (LETTER_BITS * N) | code)[ok])
    edge = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([edge, [len(keys)]]))
    keys = keys[edge]
    return keys >> (LETTER_BITS * N), keys & ((1 << LETTER_BITS * N) - 1), count, letters


def blocks(column: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.utf8_length(pc.fill_null(column, "")).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_CHARS, side="right"))
        j = max(i + 1, min(j, i + BLOCK_DOCS))
        yield column.slice(i, j - i)
        i = j


def prototypes(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from the rows of docs (text, lang) where neither is null. Each task adds
    up its own texts; dim numbers a language reach the driver, whatever the number of texts."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        sums: dict[str, np.ndarray] = {}
        grams = Grams(dim)
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            at = 0
            for part in blocks(b.column("text")):
                row, code, count, _ = counted(part)
                own = langs[at : at + len(part)]
                at += len(part)
                codes, inv = np.unique(code, return_inverse=True)
                vectors = grams.vectors(codes).astype(np.float32)
                for lang in set(own):
                    mine = (own == lang)[row]
                    c = np.bincount(inv[mine], count[mine], minlength=len(codes)).astype(np.float32)
                    sums[lang] = sums.get(lang, 0) + (c @ vectors).astype(np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim), pa.int32()), pa.array(np.rint(v).astype(np.int64))], ["lang", "d", "v"])

    learn = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    got = learn.mapInArrow(bundle, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).toPandas()
    if not len(got):
        return [], np.zeros((0, dim))
    wide = got.pivot(index="lang", columns="d", values="v").sort_index()
    return list(wide.index), wide.to_numpy(float)


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its score, under names that docs must not hold."""
    bound_batches(docs.sparkSession)
    names, dim = docs.columns, protos.shape[1] if len(protos) else DIM
    schema = docs.withColumns({lang: F.lit(""), score: F.lit(0.0)}).schema
    unit = (protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-300)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        grams = Grams(dim)
        for b in batches:
            who, much = [], []
            for part in blocks(b.column("text")):
                row, code, count, letters = counted(part)
                codes, inv = np.unique(code, return_inverse=True)
                c = np.zeros((len(part), len(codes)), np.float32)
                c[row, inv] = count
                profile = c @ grams.vectors(codes).astype(np.float32)
                cos = profile @ unit.T / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-30)
                best = cos.argmax(1) if len(langs) else np.zeros(len(part), int)
                for i in range(len(part)):
                    known = bool(letters[i]) and bool(len(langs))
                    who.append(langs[best[i]] if known else "und")
                    much.append(min(1.0, max(0.0, float(cos[i, best[i]]))) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(who, pa.string()), pa.array(much, pa.float64())], [*names, lang, score])

    return docs.mapInArrow(run, schema)


def learned(docs: DataFrame, mod: int = 4, rest: int = 2) -> tuple[list[str], np.ndarray]:
    bound_batches(docs.sparkSession)
    return prototypes(docs.where(~held_out(F.col("doc_id"), mod, rest)))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs. A null text, or one without a letter, is `und` with
    score 0, as is every text where no language could be learned; a text too short for an n-gram has a zero profile
    and gets the first language with score 0. Repeated rows get equal answers."""
    langs, protos = learned(docs)
    out = predict(docs.select("doc_id", "text"), langs, protos)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
