import random
import time
from collections import Counter, defaultdict

import helpers
import pytest
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import minhash


def grams(text):
    w = helpers.words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    texts = sorted({tuple(helpers.words(r[1])) for r in rows})
    sets = [grams(" ".join(t)) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for r in rows:
        members[find(texts.index(tuple(helpers.words(r[1]))))].append(r[0])
    out = Counter()
    for ids in members.values():
        known = [i for i in ids if i is not None]
        for i in ids:
            out[i, min(known) if known else None, len(ids)] += 1
    return out


@pytest.mark.parametrize("pairs_per_row", [0, 4])
def test_classes(spark, monkeypatch, pairs_per_row):
    monkeypatch.setattr(minhash, "PAIRS_PER_ROW", pairs_per_row)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = helpers.corpus(4)
    r = random.Random(1)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    for i in range(40):  # a group of near copies, some of them too far from all others
        copy = list(base)
        for k in r.sample(range(120), r.randint(0, 7)):
            copy[k] = f"e{r.randrange(9999)}"
        rows.append((2000 + i, " ".join(copy), None, None, None, None, None, None))
    got = minhash.near_copies(helpers.frame(spark, rows)).select("doc_id", "class_id", "class_size").collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_drop_and_empty(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rows = helpers.corpus(5, 15)
    docs = helpers.frame(spark, rows)
    left = minhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    stays = {i for (i, c, _) in brute(rows) if i == c or i is None}
    assert {r["doc_id"] for r in left.collect()} == stays
    assert minhash.near_copies(spark.createDataFrame([], helpers.SCHEMA)).count() == 0


def test_a_large_class_with_one_outsider_is_not_joined_with_itself(spark):
    n = 100_000  # the class with itself: 1e10 rows
    name = F.format_string("%08d", "id").cast("binary")
    few = spark.range(n + 1).select(
        F.lit(5).cast("long").alias("key"), name.alias("node"), F.when(F.col("id") == 70_000, F.lit("out")).otherwise(F.lit("main")).cast("binary").alias("label"), F.lit("main").cast("binary").alias("main")
    )
    start = time.monotonic()
    pairs = minhash._few_pairs(few)
    got = pairs.agg(F.count("*"), F.sum((F.col("a") > F.col("b")).cast("int")), F.sum(((F.col("a") == b"00070000") | (F.col("b") == b"00070000")).cast("int"))).first()
    assert tuple(got) == (n, n, n)
    assert time.monotonic() - start < 40


def test_pairs_across_several_classes(spark):
    rows = [(k, f"{k}{i}".encode(), label.encode(), b"m") for k in (1, 2) for i, label in enumerate("mmmmaabc")]
    got = minhash._few_pairs(spark.createDataFrame(rows, "key long, node binary, label binary, main binary")).collect()
    want = {(max(x, y), min(x, y)) for k, x, p, _ in rows for j, y, q, _ in rows if k == j and p != q}
    assert {(bytes(r.a), bytes(r.b)) for r in got} == want and len(got) == len(want)
