import math
import zlib
from collections import Counter

import helpers
import pytest

from siftline.llm import lm


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*helpers.words(lower), "</s>"]


def discounts(counts):
    n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
    if min(n) == 0:
        return [0, 0.5, 1, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) for k in (1, 2, 3))]


def brute(texts, order):
    """p(word, history) of the interpolated model."""
    grams = Counter()
    for text in texts:
        t = tokens(text)
        padded = ["<s>"] * (order - 1) + t
        grams.update(tuple(padded[i : i + order]) for i in range(len(t)))
    levels = [grams]
    while len(next(iter(levels[0]), ("x",))) > 1:
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    tables = []
    for counts in levels:
        d = discounts(counts)
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        tables.append((counts, d, total, left))

    def p(gram):
        out = 1 / (len(levels[0]) + 1)
        for n, (counts, d, total, left) in enumerate(tables, 1):
            g = gram[-n:]
            if total[g[:-1]]:
                c = counts[g]
                out = (max(c - d[min(c, 3)], 0) + left[g[:-1]] * out) / total[g[:-1]]
        return out

    return p, Counter(x for text in texts for x in tokens(text))


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, monkeypatch, order):
    monkeypatch.setattr(lm, "FLUSH_TOKENS", 500)
    monkeypatch.setattr(lm, "SCORE_TOKENS", 300)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2000)
    rows = helpers.corpus(11)
    rows += [(5000 + i, "Common common COMMON " * 150, None, None, None, None, None, None) for i in range(3)]
    docs = helpers.frame(spark, rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = lm.fit(docs.filter(~lm.held_out()), order=order)
    p, raw = brute([r[1] for r in rows if not held(r[0])], order)
    n, v = sum(raw.values()), len(raw)
    assert model.unigram[3] == v and model.unigram[5] == n
    want = {}
    for r in rows:
        t = tokens(r[1])
        padded = ["<s>"] * (order - 1) + t
        score = sum(math.log10(p(tuple(padded[i : i + order]))) for i in range(len(t)))
        base = sum(math.log10((raw[x] + 1) / (n + v + 1)) for x in t)
        want[r[0], r[1]] = len(t), sum(raw[x] > 0 for x in t), base, score, 10 ** (-score / len(t))
    out = lm.score(docs, model, out="s").collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r["s"]) == pytest.approx(want[r["doc_id"], r["text"]], rel=1e-9)
    assert sum(p(("<s>",) * (order - 1) + (w,)) for w in [*raw, "unseen"]) == pytest.approx(1)


def test_empty(spark):
    none = spark.createDataFrame([], helpers.SCHEMA)
    model = lm.fit(none)
    assert lm.score(none, model).count() == 0
    one = lm.score(spark.createDataFrame([(1, "a")], "doc_id int, text string"), model).first()["lm"]
    assert one["n_tokens"] == 2 and one["n_known"] == 0


def test_a_folder_that_cannot_be_mapped_is_refused(spark, monkeypatch):
    monkeypatch.setattr("siftline.session.shared_dir", lambda _: "hdfs://name/x")
    with pytest.raises(ValueError, match="mounted"):
        lm.fit(spark.createDataFrame([(1, "a")], "doc_id int, text string"))
