import functools
import pickle
import random
from collections import Counter

import helpers
import numpy as np
import pytest

from siftline import session
from siftline.llm import lz, repeats, suffix


def brute(rows, units, length):
    """Which units go: (id, text) to flags; a null id comes last."""
    place = lambda i: float("inf") if i is None else i
    first = {}
    for r in rows:
        u = units(r[1])
        for s in range(len(u) - length + 1):
            key = tuple(u[s : s + length])
            first[key] = min(first.get(key, float("inf")), place(r[0]))
    out = {}
    for r in rows:
        u = units(r[1])
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - length + 1):
            if first[tuple(u[s : s + length])] < place(r[0]):
                gone[s : s + length] = True
        out[r[0], r[1]] = gone
    return out


@pytest.mark.parametrize("broadcast", [0, 1 << 25])
def test_words(spark, monkeypatch, broadcast):
    monkeypatch.setattr(session, "BROADCAST_BYTES", broadcast)
    rows = helpers.corpus(9)
    shape = repeats.Shape("word", 20, 4, 4096)
    got = lz.drop_repeats(helpers.frame(spark, rows), shape=shape).collect()
    want = []
    for (i, text), gone in brute(rows, helpers.words, 20).items():
        kept = " ".join(w for w, g in zip(helpers.words(text), gone) if not g)
        want.append(repr((i, len(gone), int(gone.sum()), kept)))
    assert set(map(repr, map(tuple, got))) == set(want) and len(got) == len(rows)
    assert lz.drop_repeats(spark.createDataFrame([], helpers.SCHEMA)).count() == 0


def test_bytes(spark):
    rows = helpers.corpus(10)
    shape = repeats.Shape("byte", 50, 24, 4096)
    got = suffix.drop_repeats(helpers.frame(spark, rows), shape=shape, memory=300).collect()
    want = set()
    for (i, text), gone in brute(rows, lambda t: list((t or "").encode()), 50).items():
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        kept = np.frombuffer((text or "").encode(), np.uint8)[~gone].tobytes()
        want.add((i, len(gone), int(gone.sum()), spans, kept))
    assert {(*r[:4], bytes(r[4])) for r in map(tuple, got)} == want and len(got) == len(rows)
    assert suffix.drop_repeats(spark.createDataFrame([], helpers.SCHEMA)).count() == 0


def shared_ids(seed=3):
    """Null ids and one id on several long texts, which share some passages and are new elsewhere."""
    r = random.Random(seed)
    body = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passages = [body(30) for _ in range(3)]
    ids = [1, 2, 3] * 2 + [7] * 5 + [None] * 6
    texts = [" ".join(body(r.randint(0, 80)) + r.choice(passages) + body(r.randint(0, 80))) for _ in ids]
    return [(i, t, None, None, None, None, None, None) for i, t in zip(ids, texts)]


def test_ids_that_stand_on_several_texts(spark):
    rows = shared_ids()
    got = lz.drop_repeats(helpers.frame(spark, rows), shape=repeats.Shape("word", 20, 4, 4096)).collect()
    want = []
    for (i, text), gone in brute(rows, helpers.words, 20).items():
        want.append((i, len(gone), int(gone.sum()), " ".join(w for w, g in zip(helpers.words(text), gone) if not g)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    got = suffix.drop_repeats(helpers.frame(spark, rows), shape=repeats.Shape("byte", 50, 24, 4096)).collect()
    want = []
    for (i, text), gone in brute(rows, lambda t: list(t.encode()), 50).items():
        want.append((i, len(gone), int(gone.sum()), np.frombuffer(text.encode(), np.uint8)[~gone].tobytes()))
    assert sorted(repr((*r[:3], bytes(r[4]))) for r in map(tuple, got)) == sorted(map(repr, want))


def test_a_hot_anchor_does_not_meet_in_one_bucket(spark, monkeypatch):
    """A passage of all documents in different surroundings: same results, no bucket gets its runs."""
    monkeypatch.setattr(repeats, "HOT", 30)
    sizes = []
    grouped = type(spark.range(1).groupBy("id"))
    plain = grouped.applyInArrow

    def counting(self, function, schema):
        blobs = self._df.select("blob").collect()
        # Entries and details tell the key of each document (or run) of a bucket's blob.
        parts = [pickle.loads(x.blob) for x in blobs]
        grams = [g for q in parts if len(q) == 8 for g in q[0].tolist()]
        sizes.append(max(Counter(grams).values(), default=0))
        return plain(self, function, schema)

    monkeypatch.setattr(grouped, "applyInArrow", counting)
    r = random.Random(8)
    passage = [f"p{r.randrange(10**6)}" for _ in range(40)]
    rows = []
    for i in range(120):
        text = [f"w{r.randrange(10**6)}" for _ in range(20)] + passage + [f"w{r.randrange(10**6)}" for _ in range(20)]
        if i % 10 == 0 and rows:
            text[:25] = rows[-1][1].split()[:25]  # a part of the surroundings, too
        rows.append((r.choice([i, i, i, None, 7]), " ".join(text), None, None, None, None, None, None))
    for method, shape, cut, columns in (
        (lz, repeats.Shape("word", 20, 4, 1 << 20), helpers.words, 3), (suffix, repeats.Shape("byte", 50, 24, 1 << 20), lambda t: list(t.encode()), 3)
    ):
        got = method.drop_repeats(helpers.frame(spark, rows), shape=shape).collect()
        want = [(i, len(g), int(g.sum())) for (i, _), g in brute(rows, cut, shape.length).items()]
        assert sorted(repr(tuple(x[:columns])) for x in got) == sorted(map(repr, want))
    assert sizes and max(sizes) <= 30 + repeats.SEEN * 3


@pytest.mark.parametrize("shape", [repeats.Shape("word", 20, 4), repeats.Shape("byte", 50, 24)])
def test_pieces_of_hot_runs_cover_every_window_once_and_equal_windows_share_a_route(shape):
    r = np.random.default_rng(5)
    passage = r.integers(1, 200, 70)
    texts = [np.concatenate([r.integers(1, 200, r.integers(0, 40)), passage, r.integers(1, 200, r.integers(0, 40))]) for _ in range(30)]
    values = np.concatenate(texts).astype(np.uint8 if shape.unit == "byte" else np.uint64)
    begin = np.cumsum([0] + [len(t) for t in texts])
    x = repeats.runs(values, begin, shape)
    p = repeats._pieces(x.gram[x.anchor], x.anchor, x.first, x.last + shape.length, x.hashes, shape)
    first = x.first[p.run] + p.first
    each = repeats._spread(first, p.count)
    assert sorted(each.tolist()) == sorted(repeats._spread(x.first, x.last - x.first + 1).tolist())
    assert Counter(p.run.tolist()).most_common(1)[0][1] <= repeats.PROBES
    routes = {}
    for start, route in zip(each.tolist(), np.repeat(p.route, p.count).tolist()):
        routes.setdefault(values[start : start + shape.length].tobytes(), set()).add(route)
    assert all(len(found) == 1 for found in routes.values())


@pytest.mark.parametrize("hot", [6, 40])
def test_hot_anchors_whose_stretches_differ_go_to_the_method(spark, monkeypatch, hot):
    """Below the second limit no window is settled by hashes; above it, the edges of the passage are. The results are equal."""
    monkeypatch.setattr(repeats, "HOT", hot)
    tags = []
    plain = repeats._with_least
    monkeypatch.setattr(repeats, "_with_least", lambda flushes, tag: tags.append((tag, plain(flushes, tag))) or tags[-1][1])
    r = random.Random(21)
    body = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    core, sides = body(8), [(body(14), body(14)) for _ in range(12)]
    rows = []
    for i in range(96):
        a, b = sides[i % 12]
        text = body(r.randint(0, 9)) + a + core + b + body(r.randint(0, 9))
        rows.append((i, " ".join(text), None, None, None, None, None, None))
    shape = repeats.Shape("word", 20, 4, 1 << 20)
    got = lz.drop_repeats(helpers.frame(spark, rows), shape=shape).collect()
    want = [(i, len(g), int(g.sum())) for (i, _), g in brute(rows, helpers.words, 20).items()]
    assert sorted(tuple(x[:3]) for x in got) == sorted(want)
    assert [t for t, _ in tags] == (["hot-runs"] if hot == 40 else ["hot-runs", "hot-windows"])
    for _, told in tags:
        assert told.count() <= 96  # rows are flushes of tasks


def test_suffix_array_in_memory_and_on_disk(tmp_path):
    for seed in range(120):
        r = random.Random(seed)
        text = np.array([r.randint(1, r.choice([2, 3, 10, 300])) for _ in range(r.randint(1, 80))] + [0])
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        for memory in (5, 10**9):
            assert suffix.suffix_array(text, memory, str(tmp_path)).tolist() == want


@pytest.mark.parametrize("method", [lz.parsed, functools.partial(suffix.sorted_repeats, memory=40)])
def test_methods_agree_with_brute_force(method):
    for seed in range(60):
        r = random.Random(seed)
        segments = [[r.randint(65, 67) for _ in range(r.randint(1, 60))] for _ in range(12)]
        ids = np.array([r.randrange(6) for _ in segments])
        begin = np.cumsum([0, *map(len, segments)])
        got = method(ids, begin, np.array(sum(segments, []), np.uint8), 8)
        first = {}
        for i, s in zip(ids, segments):
            for k in range(len(s) - 7):
                key = tuple(s[k : k + 8])
                first[key] = min(first.get(key, 99), i)
        want = [k + 8 <= len(s) and first[tuple(s[k : k + 8])] < i for i, s in zip(ids, segments) for k in range(len(s))]
        assert got.tolist() == want


def test_no_window_is_lost_however_short_the_anchor():
    data = np.frombuffer(("abcdefgh" * 30 + "xyz" * 40).encode(), np.uint8)
    found = repeats.runs(data, np.array([0, 100, 100, len(data)]), repeats.Shape("byte", 30, 9))
    covered = sorted(p for a, b in zip(found.first, found.last) for p in range(a, b + 1))
    assert covered == [*range(0, 71), *range(100, len(data) - 29)]


def test_suffixes_are_compared_within_their_segments():
    r = np.random.default_rng(5)
    for high in (4, 250, 400):  # bytes are compared directly, wider units by induction
        one = r.integers(2, high, 30)
        text = np.concatenate([np.concatenate([one[: r.integers(5, 31)], [1]]) for _ in range(40)] + [[0]])
        whole = suffix.suffix_array(text)
        assert whole.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        within = [text[i : i + 1 + int(np.argmax(text[i:] <= 1))].tolist() for i in range(len(text))]
        order = suffix.suffix_array(text, apart=1).tolist()
        assert sorted(order) == list(range(len(text)))
        assert [within[i] for i in order] == sorted(within)


def test_long_byte_substrings_are_in_order():
    r = np.random.default_rng(6)
    for _ in range(60):
        steps = [np.sort(r.integers(1, 5, r.integers(1, 40)))[:: r.choice([1, -1])] for _ in range(8)]
        text = np.concatenate([*steps, *steps, [0]])
        assert suffix.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
