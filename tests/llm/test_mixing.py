import itertools
import random

import helpers

from siftline.llm import mixing


def test_targets_stop_at_twice_the_size():
    got = mixing.targets({"b": 100, "a": 10, None: 100})
    assert got["a"] == 20 and abs(sum(got.values()) - 315) < 1e-9 and abs(got[None] / got["b"] - 2) < 1e-9
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_flow_is_cheapest():
    r = random.Random(2)
    for _ in range(60):
        patterns = [(tuple(s for s in "xyz" if r.random() < 0.6) or ("x",), r.randint(0, 3)) for _ in range(3)]
        quota = {s: r.randint(0, 4) for s in "xyz"}
        flows = mixing.min_cost_flow(patterns, quota, 2)
        got = [sum(f.values()) for f in flows]
        best = None
        options = [list(itertools.product(*[range(min(quota[s], 2 * size) + 1) if s in members else [0] for s in "xyz"])) for members, size in patterns]
        for choice in itertools.product(*options):
            used = [sum(x) for x in choice]
            if all(u <= 2 * p[1] for u, p in zip(used, patterns)) and all(sum(c[k] for c in choice) <= quota[s] for k, s in enumerate("xyz")):
                cost = -sum(used) * 100 + sum(max(0, u - p[1]) for u, p in zip(used, patterns))
                best = cost if best is None or cost < best else best
        assert -sum(got) * 100 + sum(max(0, u - p[1]) for u, p in zip(got, patterns)) == best
        for f, (members, _) in zip(flows, patterns):
            assert set(f) <= set(members)


def test_mix(spark):
    rows = helpers.corpus(6, 120)
    docs = helpers.frame(spark, rows)
    got = mixing.mix(docs).collect()
    sizes, total, by = {}, {}, {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + len(helpers.words(r[1]))
        sizes.setdefault(r[0], []).append((len(helpers.words(r[1])), r[3]))
    want = mixing.targets(total)
    most = max(len(helpers.words(r[1])) for r in rows)
    assert len(got) == len(rows)
    for r in got:
        size, source = next(x for x in sizes[r["doc_id"]] if x[0] == r["size"])
        assert r["source_size"] == total[source] and abs(r["target"] - want[source]) < 1e-6
        assert r["taken"] in (0, size, 2 * size)
        by[source] = by.get(source, 0) + r["taken"]
    assert all(abs(by[s] - want[s]) <= most for s in by)
    assert sorted(map(repr, mixing.mix(docs.repartition(5)).collect())) == sorted(map(repr, got))
    assert mixing.keep_mixed(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i in range(30) for s in [[["a"], ["b"], ["a", "b"], [], None][i % 5]]], "doc_id int, text string, source array<string>")
    out = mixing.mix(docs, share=1.0).collect()
    assert len(out) == 30 and sum(r["taken"] for r in out) in range(280, 321)
