"""Length guards of the date formats leave every result as the shapes alone give it."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import values

TEXTS = [
    "2020-01-05", "2020-13-05", "2020-01-05 10:11", "2020-01-05 10:11:12", "2020-01-05 10:11:12.5", "2020-01-05 10:11:12.123456",
    "2020-01-05 10:11:12.1234567", "2020-01-05T10:11:12", "2020-01-05T10:11:12Z", "2020-01-05T10:11:12.123Z", "2020-01-05T10:11:12.123456Z",
    "2020/1/5", "2020/11/15", "1/5/2020", "25/5/2020", "13/13/2020", "20200105", "20201305", "5-Jan-2020", "15-Jan-2020", "5-Xyz-2020",
    "Jan 5, 2020", "Jan 15, 2020", "Foo 5, 2020", " 2020-01-05\t", "2020-01-05 ", "2020-01-05\u0085", "٢٠٢٠-01-05", "", " ", "x" * 40, None,
]


def _by_shape_alone(c):
    value = values.strip(c)
    tries = [F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(fmt))) for shape, fmt, _, _ in values.DATE_FORMATS]
    return F.when(F.octet_length(value) <= 32, F.coalesce(*tries))


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_shapes_alone(spark, seed):
    rng = random.Random(seed)
    mutated = []
    for _ in range(300):
        text = list(rng.choice([t for t in TEXTS if t]))
        for _ in range(rng.randint(1, 2)):
            place = rng.randrange(len(text) + 1)
            text[place : place + rng.randint(0, 1)] = rng.choice(["0", "1", "-", "/", " ", "T", "Z", ".", ""])
        mutated.append("".join(text))
    df = spark.createDataFrame([(t,) for t in TEXTS + mutated], "text string").withColumn("bare", values.strip("text"))
    got = df.select(
        "text", values.timestamp("text").alias("a"), values.stripped_timestamp("bare").alias("b"), _by_shape_alone("text").alias("expected")
    ).collect()
    assert all(r["a"] == r["expected"] and r["b"] == r["expected"] for r in got), [r for r in got if r["a"] != r["expected"]]
    assert sum(r["a"] is not None for r in got) > 25


def test_lengths_follow_the_shapes(spark):
    for shape, _, least, most in values.DATE_FORMATS:
        fitting = [t.strip() for t in TEXTS if t and spark.range(1).select(F.lit(t.strip()).rlike(shape)).first()[0] and t.strip().isascii()]
        assert fitting and all(least <= len(t) <= most for t in fitting)
