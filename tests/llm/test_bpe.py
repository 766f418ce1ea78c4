import base64
import random

import helpers
import public_tokenizers
import pytest
import tiktoken

from siftline.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(FILE, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [b"%d" % i for i in range(3000)]
    assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(3000))
    assert bpe.PerfectHash([]).slots([b"x"]).tolist() == [-1]


def test_encoder(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)  # the memory starts anew again and again
    encoder = bpe.Encoder(bpe.encoder(FILE, public_tokenizers.PATTERN).vocabulary)
    r = random.Random(1)
    alphabet = ["a", "b", "é", "ß", " ", "\n", "'s", "1", "漢", "🙂", "\x1c", "the", "\x85", "​", " "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(500)]
    texts += ["a" * 20000, "ab" * 9000, " " * 3000, "<|endoftext|>"]
    texts += texts[:100]  # come back after a generation, or two
    got = [x.tolist() for at in range(0, len(texts), 7) for x in encoder.encode(texts[at : at + 7])]
    assert got == [reference.encode_ordinary(t) for t in texts]


def test_round_trip(spark, reference):
    rows = helpers.corpus(7)
    docs = helpers.frame(spark, rows)
    coded = bpe.encode(docs, FILE, public_tokenizers.PATTERN)
    back = bpe.decode(coded, FILE)
    assert back.columns == [*docs.columns, "token_ids", "decoded"]
    got = sorted(repr((r["doc_id"], r["token_ids"], bytes(r["decoded"]))) for r in back.collect())
    assert got == sorted(repr((r[0], reference.encode_ordinary(r[1] or ""), (r[1] or "").encode())) for r in rows)
    both = bpe.encode(docs, FILE, public_tokenizers.PATTERN, decoded="kept")
    assert both.columns == [c for c in docs.columns if c != "kept"] + ["token_ids", "kept"]
    assert sorted(repr((r["doc_id"], r["token_ids"], bytes(r["kept"]))) for r in both.collect()) == got
    gone = bpe.decode(spark.createDataFrame([(None,), ([],)], "token_ids array<int>"), FILE).collect()
    assert [None if r["decoded"] is None else bytes(r["decoded"]) for r in gone] == [None, b""]
    assert bpe.encode(docs.limit(0), FILE, public_tokenizers.PATTERN).count() == 0
