"""Predicates that raise on a row, against Spark's own evaluation of that row."""

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftline.functions import guarded
from siftline.operators import rules

ROWS = [
    (1, "5", 0, [1, 2], {"a": 1}, "2024-01-02", 2147483647), (2, "x", 2, [], {}, "nope", 1), (3, None, None, None, None, None, None),
    (4, "7.5", -1, [None, 3], {"b": None}, "2024-13-01", -2147483648), (5, "-3", 1, [9], {"a": 7}, "", 40),
]
SCHEMA = "id int, text string, n int, arr array<int>, m map<string,int>, day string, big int"
PREDICATES = [
    "CAST(text AS INT) > 4", "text > 4", "10 / n > 3", "10 % n = 0", "10 div n > 3", "arr[n] = 2", "element_at(arr, n) = 2",
    "element_at(m, 'a') = 1", "m['b'] = 1", "to_date(day) > DATE'2024-01-01'", "to_timestamp(day) IS NULL", "CAST(day AS DATE) IS NOT NULL",
    "big + n > 5", "big * 2 > 5", "-big > 5", "big - 1 > 5", "n <> 0 AND 10 / n > 3", "n = 0 OR 10 / n > 3", "10 / n > 3 AND n <> 0",
    "CASE WHEN n = 0 THEN false WHEN 10 / n > 3 THEN true ELSE int(text) > 4 END", "if(n = 0, true, 10 / n > 3)", "coalesce(n, int(text)) = 1",
    "int(text) / n IN (1, 5, int(day))", "text LIKE '%5%'", "try_cast(text AS INT) = 5", "NOT (int(text) = 5)", "length(text) between 1 and 10 / n",
    "date(date(day)) > '2024-01-01'", "CAST(text AS DECIMAL(3,1)) * 100 > 5", "nullif(int(text), 5) IS NULL",
]


def test_each_predicate_as_spark_would(spark):
    rows = [spark.createDataFrame([r], SCHEMA) for r in ROWS]
    # One plan per row, so that a row that raises does not hide the others.
    spark.sparkContext.setLogLevel("OFF")
    want = {}
    for row, values in zip(rows, ROWS, strict=True):
        want[values[0]] = []
        for p in PREDICATES:
            try:
                want[values[0]].append(bool(row.select(F.expr(p).cast("boolean")).first()[0]))
            except PySparkException:
                want[values[0]].append(True)
    checked = rules.validate_frame(spark.createDataFrame(ROWS, SCHEMA), [rules.Rule(p, p) for p in PREDICATES])
    spark.sparkContext.setLogLevel("ERROR")
    differ = []
    for row in checked.collect():
        found = {v["rule"] for v in row["violations"]}
        differ += [(row["id"], p) for p, failed in zip(PREDICATES, want[row["id"]], strict=True) if failed != (p in found)]
    assert differ == []


def test_plain_predicates_stay_as_they_are(spark):
    empty = spark.createDataFrame([], SCHEMA)
    plain = ["n > 3", "text = 'x' AND n IS NULL", "exists(arr, v -> v / 0 > 1)"]
    assert guarded.guarded(empty, plain) == [(p, None) for p in plain]
    assert guarded.guarded(empty, []) == []


def test_bad_predicates_are_found_together(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    listed = [rules.Rule(f"r{i}", p) for i, p in enumerate(["n > 0", "nonsense(", "n < 5", "no_column = 1", "id > 9", "n = 1"])]
    first = rules.validate_frame(df, listed).filter("id = 5").first()
    assert [v["rule"] for v in first["violations"]] == ["r0", "r1", "r2", "r3", "r5"]
