import math
import random

import numpy as np
import pytest

from siftline.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row string, `goals` int"


def brute(rows, every=100, wanted=5):
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((math.inf if vec_id is None else vec_id, [math.floor(256 * x) for x in vector], label))

    def score(i, j):
        return sum(x * y for x, y in zip(kept[i][1], kept[j][1], strict=False))

    out = []
    for i, (anchor, _, label) in enumerate(kept):
        if anchor == math.inf or anchor % every:
            continue
        ranked = sorted((-score(i, j), kept[j][0], j) for j in range(len(kept)) if j != i)
        same = [r for r in ranked if kept[r[2]][2] == label][:wanted]
        other = [r for r in ranked if kept[r[2]][2] != label]
        for p in same:
            fits = [r for r in other if 80 * -p[0] <= 100 * -r[0] <= 100 * -p[0]][:wanted]
            for rank, r in enumerate(fits, 1):
                ids = [None if x == math.inf else x for x in (p[1], r[1])]
                out.append((anchor, ids[0], rank, ids[1], -p[0], -r[0]))
    return sorted(map(repr, out))


def got(spark, rows, every=100, partitions=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(partitions)
    out = negatives.mine(df, every=every)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(repr(tuple(r)) for r in out.collect())


@pytest.mark.parametrize("spread", [1.0, 4e4, 1e12])
def test_scores(spread):
    r = np.random.default_rng(5)
    a, c = np.floor(r.normal(0, spread, (7, 9))), np.floor(r.normal(0, spread, (37, 11)))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=False)) for v in c] for u in a]
    assert negatives.scores(a, c).tolist() == want
    assert negatives.scores(np.abs(a), np.abs(c)).tolist() == [[sum(abs(int(x) * int(y)) for x, y in zip(u, v, strict=False)) for v in c] for u in a]
    assert negatives.scores(np.zeros((2, 3)), np.zeros((4, 3))).tolist() == [[0] * 4] * 2
    assert negatives.scores(np.zeros((0, 3)), c).shape == (0, 37)


def test_best_takes_the_leftmost_of_ties():
    values = np.array([[3, 5, 5, 1, 5, 3], [2, 2, 2, 2, 2, 2]])
    for v in (values, values.astype(object)):
        row, column = negatives.best(v, 4)
        assert [column[row == i].tolist() for i in (0, 1)] == [[1, 2, 4, 0], [0, 1, 2, 3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_mine(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "CANDIDATES", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 6)
    r = random.Random(seed)
    rows = []
    for i in range(-20, 140):
        vector = [r.choice((-0.5, 0.1, 0.3, 0.5)) + (r.random() * 0.05 if i % 3 else 0) for _ in range(4)]
        rows.append((i, vector, r.choice((0, 0, 0, 1, 2))))
    rows += [(200, [0.3] * 4, 0)] * 6 + [(7, [0.3] * 6, 9), (8, [], 1), (None, [0.31] * 4, 1), (None, [0.3] * 4, 0)]
    rows += [(10, None, 1), (20, [0.1, None, 0.1, 0.1], 1), (30, [0.1, math.nan, 0.1, 0.1], 1), (40, [math.inf] * 4, 0), (50, [0.4] * 4, None)]
    r.shuffle(rows)
    assert got(spark, rows, 10) == brute(rows, 10)


def test_wide_components_and_empty(spark):
    r = random.Random(4)
    rows = [(i, [r.choice((1e5, 9e4, 3.5)) * r.random() for _ in range(3)], i % 2) for i in range(60)]
    assert got(spark, rows, 10) == brute(rows, 10)
    assert got(spark, rows[1:9], 100) == [] == got(spark, [], 100)
    assert got(spark, [(100, [0.5], 3)], 100) == []


def test_no_side_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CANDIDATES", 20)
    monkeypatch.setattr(negatives, "ANCHORS", 6)
    monkeypatch.setattr(negatives, "GROUP_BYTES", 60 * 4 * 8)
    r = random.Random(6)
    rows = [(i % 150, [r.choice((-0.5, 0.25, 0.5, -1e20 if i == 77 else 0.3)) for _ in range(4)], r.choice((0, 0, 1))) for i in range(240)]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA)
    out = negatives.mine(df, every=10)
    # Small files are broadcast by every join; a copy for each group of candidates would meet in the driver.
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(repr(tuple(x)) for x in out.collect()) == brute(rows, 10)


def test_groups_follow_memory_then_cores():
    fit = negatives.GROUP_BYTES // (8 * 64)
    assert negatives._groups(100 * fit, fit, 64, 10**6, 4) == 100  # what fits in a task
    assert negatives._groups(3 * fit, fit // 100, 64, 10**6, 4) == 8  # for all cores
    assert negatives._groups(3 * fit, fit // 100, 64, 5, 4) == 5  # a block is in one group
    assert negatives._groups(fit, fit // 4, 64, 10**6, 50) == 4  # anchors sent take no more than the candidates
    assert negatives._groups(0, 0, 0, 1, 8) == 1
