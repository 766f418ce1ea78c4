"""Row places, mergeable profiles, one-pass outputs and replacing loads."""

import random

import pytest
from pyspark.sql import functions as F

from siftline import session
from siftline.operators import checks, load, profile, report
from siftline.sources import jdbc, sinks


def _stored(spark, tmp_path, rows, schema, files=3):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def test_places_are_unique_and_stay(spark, tmp_path):
    df = _stored(spark, tmp_path, [(i % 3,) for i in range(50)], "v int")
    places = [tuple(r["_place"]) for r in session.placed(df).collect()]
    assert len(set(places)) == 50 and sorted(places) == sorted(tuple(r["_place"]) for r in session.placed(df.repartition(7).unionAll(df.limit(0)).sparkSession.read.parquet(str(tmp_path / "t"))).collect())
    kept = session.placed(df.filter("v = 1").select((F.col("v") + 1).alias("w")))
    assert kept.columns == ["w", "_place"] and {tuple(r["_place"]) for r in kept.collect()} < set(places)
    joined = session.placed(df.join(df.select(F.col("v").alias("u")).distinct(), F.col("u") == F.col("v")))
    exploded = session.placed(df.select("v", F.explode(F.array(F.lit(1), F.lit(2))).alias("e")))
    for other, n in ((joined, 50), (exploded, 100)):
        assert len({tuple(r["_place"]) for r in other.collect()}) == n


def test_beyond_first_with_ties(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (2, 1, "d")], "k int, o int, v string").coalesce(1)
    assert sorted(r["v"] for r in report.beyond_first(df, ["k"], ["o"]).collect()) == ["b", "c"]
    same = spark.createDataFrame([(None, 1)] * 40 + [(5, 1)] * 3, "k int, o int")
    assert report.beyond_first(same, ["k"], ["o"]).count() == 41


def test_first_values(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    rows = [(i, str(i) if i > 60 else None, 7 if i == 90 else None, None, r.random()) for i in range(120)]
    df = _stored(spark, tmp_path, rows, "i int, late string, once int, never string, x double")
    placed = sorted((tuple(row["_place"]), tuple(row)[:5]) for row in session.placed(df).collect())
    want = [[str(v[c]) for _, v in placed if v[c] is not None][:2] for c in range(5)]
    for head in (100, 1, 0):
        monkeypatch.setattr(profile, "HEAD_ROWS", head)
        assert profile.first_values(df) == want
    assert profile.first_values(df.limit(0)) == [[]] * 5
    shown = {row["column"]: row["samples"] for row in profile.column_profile(df).collect()}
    assert shown == {c: ", ".join(v) or None for c, v in zip(df.columns, want, strict=True)}


def test_parts_merge_to_the_whole(spark):
    rows = [(i % 500, None if i % 7 == 0 else f"t{i % 90}", float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, t string, x double")
    parts = session.stage(profile.profile_parts(df, F.col("k") % 4), "parts")
    assert parts.count() == 12
    merged = {r["column"]: r for r in profile.merge_profiles(parts).collect()}
    whole = {r["column"]: r for r in profile.column_profile(df).collect()}
    for name, row in whole.items():
        for fact in ("data_type", "non_null", "nulls", "min_length", "max_length"):
            assert merged[name][fact] == row[fact]
        assert abs(merged[name]["distinct_estimate"] - row["distinct_values"]) <= 0.05 * row["distinct_values"]


def test_duplicate_rows_are_told_apart_by_every_cell(spark):
    rows = [("a", "b", 1.0), ("a", "b", 1.0), ("ab", "", 1.0), ("a", None, 1.0), ("a", "", 1.0), (None, "a", 0.0), (None, "a", -0.0), ("1:a", "b", None)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    assert profile.duplicate_rows(df).first()[0] == 2
    assert profile.duplicate_rows(df.limit(0)).first()[0] == 0


@pytest.fixture
def counted(spark):
    """A frame that counts how often its rows are worked out."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def look(x):
        seen.add(1)
        return x

    return spark.range(300).repartition(3).select(look(F.col("id").cast("int")).alias("id")), seen


def test_outputs_work_rows_out_once(spark, tmp_path, counted):
    df, seen = counted
    sinks.split_write(df, str(tmp_path / "a"), above=100, per_file=60)
    assert seen.value == 300
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 300
    sinks.split_write(df, str(tmp_path / "b"), above=1000)
    assert seen.value == 600  # gathered from the files, not from the rows
    one = spark.read.option("header", True).csv(str(tmp_path / "b"))
    assert one.count() == 300 and len(one.inputFiles()) == 1
    checked = checks.with_violations(df, []).withColumn("is_valid", F.when(F.col("id") % 50 != 0, F.col("id") % 3 != 0))
    sinks.write_split(checked, str(tmp_path / "c"))
    assert seen.value == 900
    sides = {s: {int(r["id"]) for r in spark.read.option("header", True).csv(str(tmp_path / "c" / s)).collect()} for s in ("valid", "invalid")}
    assert sides["valid"] == {i for i in range(300) if i % 50 and i % 3} and sides["invalid"] == set(range(300)) - sides["valid"]


def test_gathered_cells_are_as_written_at_once(spark, tmp_path):
    rows = [("a,b", 'say "x"'), ("line\nbreak", None), ("", " blank "), (None, "\\"), ("é", "1e5")]
    df = spark.createDataFrame(rows, "x string, y string").repartition(3)
    sinks.split_write(df, str(tmp_path / "p"))
    df.coalesce(1).write.options(**sinks._TEXT).csv(str(tmp_path / "q"))
    gathered, direct = (spark.read.options(multiLine=True, **sinks._TEXT).csv(str(tmp_path / d)) for d in "pq")
    assert len(gathered.inputFiles()) == 1
    assert sorted(map(repr, gathered.collect())) == sorted(map(repr, direct.collect()))
    assert ("a,b", 'say "x"') in [tuple(r) for r in gathered.collect()] and ("line\nbreak", None) in [tuple(r) for r in gathered.collect()]


def test_replacing_a_table_from_itself(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "id int, v string")
    spark.sql("DROP TABLE IF EXISTS t_swap")
    sinks.load_table(df, "t_swap", "create")
    sinks.load_table(spark.table("t_swap").filter("id < 5"), "t_swap", "truncate")
    assert spark.table("t_swap").count() == 5
    sinks.load_table(spark.table("t_swap").select("id", F.lit(1.5).alias("w")), "t_swap", "replace")
    assert spark.table("t_swap").columns == ["id", "w"] and spark.table("t_swap").count() == 5
    # A load that fails leaves the table as it was, and does not stand in the way of the next one.
    broken = spark.table("t_swap").select(F.expr("CAST(concat('x', id) AS INT) AS id"), "w")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sinks.load_table(broken, "t_swap", "delete")
    assert spark.table("t_swap").count() == 5
    sinks.load_table(spark.table("t_swap").filter("id = 1"), "t_swap", "delete")
    assert [tuple(r) for r in spark.table("t_swap").collect()] == [(1, 1.5)]
    spark.sql("DROP TABLE t_swap")


def test_database_loads_are_refused_by_the_target(spark):
    with pytest.raises(ValueError, match="does not exist"):
        jdbc.jdbc_write_options("jdbc:x", "t", "append", exists=False)
    with pytest.raises(ValueError, match="already exists"):
        jdbc.jdbc_write_options("jdbc:x", "t", "create", exists=True)
    with pytest.raises(ValueError, match="unknown"):
        jdbc.jdbc_write_options("jdbc:x", "t", "merge")
    assert jdbc.jdbc_write_options("jdbc:x", "t", "append", exists=True)[0] == "append"
    assert not jdbc.table_exists(spark, "jdbc:none://x", "t")


def test_keyless_target_rows_stay_out_of_the_join(spark):
    source = spark.createDataFrame([(1, "new", 9), (3, "more", 9)], "k int, v string, batch int")
    target = spark.createDataFrame([(1, "old")] + [(None, f"n{i}") for i in range(30)], "k int, v string")
    merged = load.upsert(source, target, "k", carry=["batch"])
    rows = sorted(map(repr, ((r["k"], r["v"], r["batch"], r["outcome"]) for r in merged.collect())))
    assert rows == sorted(map(repr, [(1, "new", 9, "updated"), (3, "more", 9, "created")] + [(None, f"n{i}", None, "kept") for i in range(30)]))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull" in plan.split("Join FullOuter")[1]


@pytest.mark.parametrize("limit", [0, 1000])
def test_issues_do_not_depend_on_the_size_of_a_list(spark, monkeypatch, limit):
    from siftline.operators import catalog

    monkeypatch.setattr(checks, "INLINE_PICKLIST", limit)
    listed = [(" X", True), (" Y ", True), ("\tZ", True)]
    cat = catalog.catalog_rows(spark, [dict(object="A", name="p", label="p", type="picklist", nillable=True, picklist=listed)])
    df = spark.createDataFrame([("X",), (" X",), ("Y",), ("Z\n",), (" Y",)], "p string")
    got = {r["p"]: bool(r["Issues"]) for r in checks.issues_column(df, cat).collect()}
    assert got == {"X": True, " X": False, "Y": False, "Z\n": False, " Y": True}
