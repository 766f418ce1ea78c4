import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert out.filter(~F.col("round_trip") | (F.size("token_ids") != F.col("n_tokens"))).count() == 0
    assert 0 < out.select("doc_id").distinct().count() <= 200
