"""The pipeline's stages, each on what the one before kept, against the operators' own answers."""

from compare import SMALL
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gaugeflow.llm import langid, minhash, toxicity


def write(spark, df, path):
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    now, kept = docs, {}
    for name, stage in cp.STAGES:
        out = write(spark, stage(spark, now, SMALL), str(tmp_path / name))
        if name != "packing":
            assert out.columns == docs.columns
            assert out.schema == docs.schema
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.classify(now, labels).where("predicted = 1").collect()}
            assert ids(out) == ids(now) - bad
        elif name == "language":
            assert ids(out) == {r["doc_id"] for r in langid.identify(now).where("lang_pred <> 'und'").collect()}
        elif name == "lines":
            assert ids(out) == ids(now)
            lines = [x for r in out.collect() for x in r["text"].split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
            assert out.where(F.char_length("text") != F.col("n_chars")).count() == 0
        elif name == "near_duplicates":
            assert ids(out) == {r["doc_id"] for r in minhash.classes(now).where("kept").collect()}
        else:
            assert ids(out) == ids(now)
            assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t").count() == 0
        kept[name], now = out.count(), out
    assert cp.run(spark, SMALL).count() == kept["packing"]


def test_stages_on_awkward_and_empty_tables(spark, awkward, nothing):
    for df in (awkward, nothing):
        for name, stage in cp.STAGES:
            out = stage(spark, df, SMALL)
            n = out.count()
            assert n <= 4 * df.count()
            if name != "packing":
                assert out.columns == df.columns
