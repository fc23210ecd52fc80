"""The pipeline's stages, one after the other, against models."""

import collections

import pytest
from pyspark.sql import functions as F
from test_small import brute_classes, norm

from revloom.llm import mixing, quality

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_models(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("a`b", F.create_map(F.lit("k"), F.lit(1)))
    extra = docs.limit(1).withColumns({"doc_id": F.lit(-1).cast(docs.schema["doc_id"].dataType), "text": F.lit(None).cast("string")})
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(extra)
    out = [docs]
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], "").write.parquet(str(tmp_path / str(n)))
        out.append(spark.read.parquet(str(tmp_path / str(n))))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert all(df.columns == docs.columns for df in out[1:-1])
    assert ids(out[1]) == ids(quality.quality_report(docs).filter("kept"))
    first = {}
    for r in out[1].collect():
        first[norm(r.text)] = min(r.doc_id, first.get(norm(r.text), r.doc_id))
    assert ids(out[2]) == sorted(first.values())
    classes = brute_classes([(r.doc_id, r.text) for r in out[2].collect()])
    assert ids(out[3]) == sorted(set(classes.values()))
    taken = {r.doc_id: round(r.taken / r.size) for r in mixing.mixture(out[3], whole_documents=True).collect()}
    assert collections.Counter(ids(out[4])) == {i: n for i, n in taken.items() if n}
    assert collections.Counter(ids(out[5].filter("piece = 0"))) == collections.Counter(ids(out[4]))
    ends = out[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.filter("n != end or n > 4096").count() == 0


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
