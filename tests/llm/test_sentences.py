import random

import helpers
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from siftline.llm import queries, sentences

FILE = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "é", " ", "  ", "\n", "'s", "1", "漢", "🙂", "\x1c", "the", "\x85", "▁", "\t", "<0x41>", "<unk>", "in", "tion", "\x00", "�", "ꙮ"]


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def encoded(m, texts):
    ids, counts = m.encode(texts)
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for n, e in zip(counts, ends, strict=True)], m.decode(ids, counts).to_pylist()


@pytest.mark.parametrize("separable", [True, False])
def test_encode(reference, monkeypatch, separable):
    m = sentences.Model(FILE)
    assert m.separable
    m.separable = separable  # without chunks, a text is segmented as a whole
    monkeypatch.setattr(sentences, "BLOCK_CHARS", 500)
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(600)]
    texts += ["a" * 9000, "ab" * 3000, " " * 3000, "", "x" * 33, " ".join(["the"] * 500), "ꙮ" * 100]
    ids, back = encoded(m, texts)
    assert ids == [reference.encode(t) for t in texts]
    assert back == [reference.decode(i) for i in ids]


def test_decode_any_ids(reference):
    m, r = sentences.Model(FILE), random.Random(2)
    for _ in range(800):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(262) for _ in range(r.randint(0, 12))]
        assert m.decode(np.array(ids, np.int64), np.array([len(ids)])).to_pylist() == [reference.decode(ids)]
    with pytest.raises(ValueError):
        m.decode(np.array([32000]), np.array([1]))


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(sentences.common, "mix", lambda x: x * np.uint64(0))  # every chunk has the same hash
    chars = np.array([ord(c) for c in "aabaab"], np.uint32)
    start, size = np.array([0, 1, 3, 4]), np.array([1, 2, 1, 2])
    code, distinct = sentences.distinct_chunks(chars, start, size)
    shown = ["".join(map(chr, chars[start[d] : start[d] + size[d]])) for d in distinct[code]]
    assert shown == ["a", "ab", "a", "ab"]


def test_operator(spark, reference):
    rows = helpers.corpus(9)
    docs = helpers.frame(spark, rows)
    both = sentences.encode(docs, FILE, decoded="back")
    assert both.columns == [*docs.columns, "token_ids", "back"]
    ids = [reference.encode(r[1] or "") for r in rows]
    want = sorted(repr((r[0], i, reference.decode(i))) for r, i in zip(rows, ids, strict=True))
    assert sorted(repr((r["doc_id"], r["token_ids"], r["back"])) for r in both.collect()) == want
    apart = sentences.decode(sentences.encode(docs, FILE), FILE, out="back")
    assert sorted(repr((r["doc_id"], r["token_ids"], r["back"])) for r in apart.collect()) == want
    assert sentences.encode(docs, FILE, out="kept", decoded="key").columns == [c for c in docs.columns if c not in ("kept", "key")] + ["kept", "key"]
    assert sentences.encode(docs.limit(0), FILE, decoded="back").count() == 0
    gone = sentences.decode(spark.createDataFrame([(None,), ([],), ([259],)], "token_ids array<int>"), FILE)
    assert sorted(map(repr, (r["decoded"] for r in gone.collect()))) == ["' '", "''", "None"]


def test_query(spark, reference):
    import hashlib

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_sentencepiece"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect():
        ids = reference.encode(row[1])
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), reference.decode(ids))]
        assert got.pop(row[0]) == (len(ids), *sha)
    assert not got
