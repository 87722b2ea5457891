"""The corpus pipeline: toxicity, language, repeated lines, near-duplicates, packing.

Each stage takes what the one before kept, written as Parquet and read again, and returns the columns of documents but
for the last, which returns packed pieces. Edge cases are those of the operators in gaugeflow.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import langid, linedup, minhash, packing, tokens, toxicity
from gaugeflow.llm.common import Scratch, bound_batches, free_name, table

END_ID = 2


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, doesn't hold toxic. Null texts stay."""
    bound_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score, toxic = free_name(docs.columns, "__score"), free_name(docs.columns, "__toxic")
    return toxicity.score(docs, model, score, toxic).where(F.col(toxic) == 0).select(docs.columns)


def language_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from these documents: texts that are null or hold no letter go."""
    lang, score = free_name(docs.columns, "__lang"), free_name(docs.columns, "__score")
    return langid.predict(docs, *langid.learned(docs), lang, score).where(F.col(lang) != "und").select(docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each line, exact or fuzzy, at its first place only; n_chars follows the text. A document that
    loses all its lines stays, with an empty text."""
    out = linedup.clean(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id."""
    return minhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, tokens.default_path(), END_ID)


STAGES = [
    ("toxicity", toxic_out),
    ("language", language_in),
    ("lines", lines_once),
    ("near_duplicates", near_copies_out),
    ("packing", packed),
]

#: Classifiers, MinHash and dynamic programming are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
