import random
import re
import zlib
from collections import Counter, defaultdict

import helpers
import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import divergence


def brute(rows, least, top):
    """The contract, word by word: rows of (text, lang, source)."""
    counts, seen = defaultdict(Counter), Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(divergence.TERM, lowered)
        counts[lang, source].update(words)
        seen.update((lang, w) for w in set(words))
    kept = defaultdict(list)
    for (lang, w), n in seen.items():
        if n >= least:
            kept[lang].append(w)

    def shares(c, lang):
        words = kept[lang]
        total = sum(c[w] for w in words)
        return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * len(words)) for w in words}

    out = []
    for lang, source in counts:
        p = shares(counts[lang, source], lang)
        others = []
        for (lang2, source2), c in counts.items():
            if lang2 == lang and source2 != source:
                q = shares(c, lang)
                others.append((-sum(abs(p[w] - q[w]) for w in p), source2.encode()))
        whole = shares(sum((c for (l2, _), c in counts.items() if l2 == lang), Counter()), lang)
        terms = [(whole[w] - p[w], w.encode()) for w in p if counts[lang, source][w] and p[w] > whole[w]]
        for part, listed in (("pair", sorted(others)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, i) for i, (v, item) in enumerate(listed, 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("slices", [1, 3])
@pytest.mark.parametrize("least", [2, 6])
def test_audit(spark, monkeypatch, slices, least):
    monkeypatch.setattr(divergence, "_slices", lambda *_: slices)
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", 60)
    rows = helpers.corpus(11, 60) + [(900, "ÄB ÄB zz [a]b", "", "s9", "k", 7, 1, None), (901, None, "", "s8", "k", 7, 1, None)]
    want = brute([(r[1], r[2], r[3]) for r in rows], least, 4)
    assert got(divergence.audit(helpers.frame(spark, rows), least, 4)) == want
    assert {r[2] for r in want} == {"pair", "term"}


def test_nothing_kept_and_nothing_there(spark):
    rows = helpers.corpus(12, 20)
    docs = helpers.frame(spark, rows)
    assert got(divergence.audit(docs, 10_000)) == brute([(r[1], r[2], r[3]) for r in rows], 10_000, 50)
    assert got(divergence.audit(docs.limit(0))) == []


def test_slices_follow_the_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PROBE", 1)
    tokens = spark.createDataFrame([([f"w{i}" for i in range(100)],)] * 3, "tokens array<string>")
    assert divergence._slices(tokens, 3) == 1
    monkeypatch.setattr(divergence, "MODEL_TERMS", 50)
    assert divergence._slices(tokens, 3) == 4
    assert divergence._slices(tokens, 4) == 1


def lists(batches):
    return [row for batch in batches for row in batch.to_pylist()]


@pytest.mark.parametrize("flush", [1, 90, 1 << 20])
def test_documents_are_merged_before_the_vectorizer(monkeypatch, flush):
    monkeypatch.setattr(divergence, "FLUSH_BYTES", flush)
    rows = [("a", "s", "Ab ab cd"), ("a", "s", ""), ("a", "t", "ab, \u00e9b"), ("", "s", "ab"), ("a", "s", "cd-ab"), ("a", "t", "..."), ("a", "s", "ab\x00ef")] * 2
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    pieces = [batch.slice(0, 3), batch.slice(3, 11)]
    counts, documents = Counter(), Counter()
    for lang, source, text in rows:
        found = re.findall(divergence.TERM, text.lower())
        counts.update((lang, source, w) for w in found)
        documents.update(lang + "\x00" + w for w in set(found))
    merged, sums = lists(divergence._merged(pieces)), Counter()
    for row in merged:
        assert len(set(row["tokens"])) == len(row["tokens"])
        for token in row["tokens"]:
            lang, _, term = token.rpartition("\x00")
            assert lang == row["lang"]
            sums[lang, row["source"], term] += row["times"]
    assert sums == counts
    for least in (1, 3, 50):
        seen = Counter()
        for row in lists(divergence._once(pieces, least, False)):
            assert len(set(row["tokens"])) == len(row["tokens"])
            seen.update(row["tokens"])
        assert {t for t, n in seen.items() if n >= least} == {t for t, n in documents.items() if n >= least}
    if flush > 90:  # every term once for each number of times, and in no more rows than asked for
        assert sum(len(row["tokens"]) for row in merged) == len(counts)
        assert max(Counter(t for row in lists(divergence._once(pieces, 3, False)) for t in row["tokens"]).values()) == 3
    monkeypatch.setattr(divergence, "PROBE", 2)
    asked = Counter(t for row in lists(divergence._once(pieces, 50, True)) for t in row["tokens"])
    assert asked == {t: n for t, n in documents.items() if zlib.crc32(t.rpartition("\x00")[2].encode()) % 2 == 0}


def test_parts_are_merged_before_the_vectorizer(monkeypatch):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice("st"), " ".join(r.choice("uvwxyz") * r.randint(1, 9) for _ in range(r.randint(0, 60)))) for _ in range(80)]
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    monkeypatch.setattr(divergence, "FLUSH_BYTES", 1)
    counts, documents = Counter(), Counter()
    for lang, source, text in rows:
        counts.update((lang, source, w) for w in text.split())
        documents.update(lang + "\x00" + w for w in set(text.split()))

    def check(batches):
        merged, once = lists(divergence._merged(batches)), Counter(t for row in lists(divergence._once(batches, 3, False)) for t in row["tokens"])
        sums = Counter()
        for row in merged:
            assert len(set(row["tokens"])) == len(row["tokens"])
            for token in row["tokens"]:
                sums[row["lang"], row["source"], token.rpartition("\x00")[2]] += row["times"]
        assert sums == counts
        assert {t for t, n in once.items() if n >= 3} == {t for t, n in documents.items() if n >= 3}
        return sum(len(row["tokens"]) for row in merged), once

    # Documents numbered one by one, and parts of them, meet before the vectorizer sees them.
    assert check([batch]) == (len(counts), {t: min(n, 3) for t, n in documents.items()})
    parts = [p.select(["part"]) for i in range(0, 80, 20) for p in divergence._parts([batch.slice(i, 20)])]
    assert len(parts) == 4
    assert check(parts) == (len(counts), {t: min(n, 3) for t, n in documents.items()})
    # Small rows, and merges of a part or two.
    monkeypatch.setattr(divergence, "ROW_BYTES", 60)
    monkeypatch.setattr(divergence, "AT_ONCE", 7)
    monkeypatch.setattr(divergence, "HELD_BYTES", 3000)
    check(parts)
    assert max(len(row["tokens"]) for row in lists(divergence._once(parts, 3, False))) <= 4
    assert len(list(divergence._parts([batch]))) > 1


def test_texts_are_read_once(spark):
    rows = helpers.corpus(13, 30)
    docs, read = helpers.frame(spark, rows), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    divergence.term_counts(docs.mapInArrow(seen, docs.schema), 2)
    assert read.value == len(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_block_distances():
    r = np.random.default_rng(3)
    for sources, terms in ((1, 4), (2, 0), (5, 30), (12, 7)):
        base = r.integers(1, 50, sources)
        has = r.random((sources, terms)) < 0.4
        has[:, has.sum(0) == 0] = True if terms else False
        dense = np.where(has, r.integers(50, 900, (sources, terms)), base[:, None])
        who, term = np.nonzero(has)
        x = dict(divergence.block_distances(who, term * 7, dense[who, term], base))
        for g in range(sources):
            for h in range(sources):
                if g != h:
                    assert x[g][h] + x[h][g] == np.abs(dense[g] - dense[h]).sum()
