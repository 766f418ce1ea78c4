"""Stateless operators on a stream."""

from pyspark.sql import functions as F

from siftline.operators import checks, cleaning, rules
from siftline.operators.catalog import catalog_rows


def test_checks_and_rules_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.co"), (2, " bad "), (3, None)], "id int, email string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, email string").parquet(str(tmp_path / "in"))
    cat = catalog_rows(spark, [dict(object="C", name="email", type="email", nillable=False)])
    checked = checks.validate_schema(cleaning.clean_values(stream), cat).select("id", F.col("is_valid").alias("schema_ok"), "email")
    ruled = rules.validate_frame(checked, [rules.Rule("odd", "id % 2 = 1")]).select("id", "schema_ok", "is_valid")
    query = ruled.writeStream.format("memory").queryName("checked_stream").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r["id"]: (r["schema_ok"], r["is_valid"]) for r in spark.table("checked_stream").collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False)}
