"""Skewed keys, ties and plan shapes."""

import random
from collections import Counter

from pyspark.sql import functions as F

from siftline import session
from siftline.operators import checks, keyed, load, lookup, report


def _skewed(spark, n=3000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randint(0, 400)}" if i % 2 else "L" * 200 + str(rng.randint(0, 9))
        rows.append((i, key))
    return rows, spark.createDataFrame(rows, "id long, key string")


def test_attach_duplicates_equals_brute_force(spark):
    rows, df = _skewed(spark)
    counts = Counter(k for _, k in rows if k is not None)
    expected = {i: counts[k] if k is not None and counts[k] > 1 else None for i, k in rows}
    table = keyed.duplicate_counts(df, F.col("key"))
    for limit, heavy in ((None, 50_000), (0, 4), (0, 10**9)):
        out = keyed.attach_by_key(df, keyed.group_key(F.col("key")), table, ["rows"], weight="rows", broadcast_bytes=limit, heavy_keys=heavy)
        assert {r["id"]: r["rows"] for r in out.collect()} == expected
    out = keyed.attach_by_key(df, keyed.group_key(F.col("key")), table, ["rows"], broadcast_bytes=0)
    assert {r["id"]: r["rows"] for r in out.collect()} == expected


def test_heavy_keys_never_exceed_their_bound(spark):
    rows, df = _skewed(spark)
    table = keyed.duplicate_counts(df, F.col("key"))
    total = table.agg(F.sum("rows")).first()[0]
    for bound in (1, 3, 10):
        assert table.filter(F.col("rows") * bound > total).count() < bound or bound == 1


def test_lookup_paths_agree(spark):
    rows, df = _skewed(spark)
    parent = spark.createDataFrame([(f"id{i:013d}", f"k{i % 300}") for i in range(600)] + [("hotid", "hot")], "Id string, Name string")
    small = lookup.resolve_lookup(df, lookup.Lookup("key", parent))
    large = lookup.resolve_lookup(df, lookup.Lookup("key", parent), broadcast_bytes=0)
    assert sorted(small.collect()) == sorted(large.collect()) if None not in [r["key"] for r in small.collect()] else (
        {r["id"]: r["key"] for r in small.collect()} == {r["id"]: r["key"] for r in large.collect()}
    )


def test_batches_are_contiguous_and_whole(spark):
    rows, df = _skewed(spark, 1000)
    out = load.assign_batches(df, ["key"], 64, partitions=7).collect()
    assert sorted(r["row_index"] for r in out) == list(range(1000))
    assert Counter(r["batch_num"] for r in out) == Counter(i // 64 + 1 for i in range(1000))
    ordered = [r["key"] or "" for r in sorted(out, key=lambda r: r["row_index"])]
    assert ordered == sorted(ordered)
    same = spark.range(500).select(F.lit(1).alias("x"))
    assert {r["row_index"] for r in load.assign_batches(same, ["x"], 100).collect()} == set(range(500))


def test_beyond_first_equals_brute_force(spark):
    rows, df = _skewed(spark)
    seen, expected = set(), set()
    for i, k in rows:
        if k in seen:
            expected.add(i)
        seen.add(k)
    assert {r["id"] for r in report.beyond_first(df, ["key"], ["id"]).collect()} == expected


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_checks_are_one_scan_without_python(spark, tmp_path):
    spark.range(100).selectExpr("id", "CAST(id AS STRING) AS a", "'x' AS unused").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select("id", "a")
    c = checks.values.cell(df, "a")
    plan = _plan(checks.with_violations(df, checks.field_checks(c, checks.Field("a", "int", 2, False))))
    assert plan.count("FileScan") == 1 and "Python" not in plan and "Exchange" not in plan
    assert "unused" not in plan


def test_report_needs_one_shuffle_by_field(spark):
    df = spark.range(10).selectExpr("CAST(id AS STRING) AS a")
    c = checks.values.cell(df, "a")
    plan = _plan(report.error_report(checks.with_violations(df, checks.field_checks(c, checks.Field("a", "email", 2, False)))))
    assert "Join" not in plan and plan.count("Exchange") <= 2


def test_staged_tables_use_the_named_folder(spark):
    df = session.stage(spark.range(3).toDF("x"), "t")
    assert session.shared_dir(spark).replace("file:", "") in df.inputFiles()[0]
    assert df.count() == 3


def test_batches_take_columns_that_cannot_be_hashed(spark):
    from siftline.operators import load

    df = spark.createDataFrame([(i, {"a": i}) for i in range(25)], "id int, m map<string,int>")
    out = load.assign_batches(df, ["id"], 10).orderBy("row_index").collect()
    assert [r["batch_num"] for r in out] == [1] * 10 + [2] * 10 + [3] * 5 and [r["id"] for r in out] == list(range(25))


def test_a_hot_key_with_a_long_payload_is_split(spark):
    from siftline import session
    from siftline.operators import keyed

    rows = spark.createDataFrame([("hot",)] * 50 + [("cold",)] * 3 + [(None,)] * 4, "k string")
    table = session.stage(spark.createDataFrame([("hot", "x" * 5000, 50), ("cold", "y" * 5000, 3)], "key string, v string, n long"), "t")
    out = keyed.attach_by_key(rows, rows["k"], table, ["v"], weight="n", broadcast_bytes=0, heavy_keys=2)
    assert {(r["k"], (r["v"] or "")[:1]) for r in out.collect()} == {("hot", "x"), ("cold", "y"), (None, "")} and out.count() == 57
