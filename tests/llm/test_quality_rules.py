import math
import random
import re

import helpers
import pytest
from pyspark.sql import functions as F

from siftline.llm import quality_rules as q


def brute(text):
    w = helpers.words(text)
    lines = [x for x in (text or "").split("\n") if helpers.words(x)]
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rows = helpers.corpus(3)
    r = random.Random(5)
    for i in range(30):
        loop = [r.choice("abc#|") for _ in range(r.randint(1, 12))]
        rows.append((1000 + i, " ".join(loop * r.randint(1, 6)) + "\nx y\nx y\n\nx y ", None, None, None, None, None, None))
    got = q.measures(helpers.frame(spark, rows)).select("_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(repr, [tuple(x) for x in got])) == sorted(repr((x[0], *brute(x[1]))) for x in rows)


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 5, 60, 400, 5000) for k in range(0, n, max(1, n // 7)) for p in (0.02, 0.3)]
    for p in (0.02, 0.3):
        rows = [(n, k) for n, k, x in cases if x == p]
        for r in spark.createDataFrame(rows, "n long, k long").withColumn("t", q.binomial_tail(F.col("n"), F.col("k"), p)).collect():
            n, k = r["n"], r["k"]
            want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
            assert r["t"] == 1 if k >= n * p else r["t"] == pytest.approx(want, rel=1e-9)


def test_cutoffs_hold_their_risk(spark):
    r = random.Random(9)
    good = [" ".join(r.choice("abcdefgh") * 3 + str(r.randrange(99)) for _ in range(40)) for _ in range(1200)]
    bad = [" ".join(r.choice("abcdefgh") + "***" for _ in range(40)) for _ in range(300)]
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 1200)) for i in range(1500)] + [(1, None), (None, 1), (99999, 1)], "doc_id long, quality int")
    out = q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    passed = {x["doc_id"]: x["passed"] for x in out}
    assert all(passed[i] for i in range(1200)) and not any(passed[i] for i in range(1200, 1500))
    none = q.judge(spark.createDataFrame(rows[:20], "doc_id long, text string, lang string"), labels.limit(0)).collect()
    assert len(none) == 20 and all(x["passed"] for x in none)
    assert q.judge(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
