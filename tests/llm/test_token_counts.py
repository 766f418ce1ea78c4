import random

import helpers
import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from siftline.llm import token_counts

FILE = public_tokenizers.path("piece_bpe_32k.model")


def reference(pieces, by_bytes):
    out = Tokenizer(models.Unigram(pieces, 0, by_bytes))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(out.encode(text, add_special_tokens=False).ids)


def test_ties_and_unknown_characters():
    r = random.Random(0)
    for _ in range(150):
        pieces = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))): -float(r.randint(1, 6)) for _ in range(r.randint(1, 12))}
        pieces = [("<unk>", 0.0), *pieces.items()]
        want, got = reference(pieces, False), token_counts.Counter(pieces)
        for _ in range(20):
            text = "".join(r.choice("abcd  ▁") for _ in range(r.randint(0, 14)))
            assert got.count_text(text) == want(text), (pieces, text)


def test_counts(spark):
    rows = helpers.corpus(8)
    want = reference(token_counts.read_pieces(FILE), True)
    got = token_counts.count_tokens(helpers.frame(spark, rows), FILE).select("doc_id", "n_tokens").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], want(r[1] or ""))) for r in rows)
    assert token_counts.count_tokens(spark.createDataFrame([], helpers.SCHEMA), FILE).count() == 0
