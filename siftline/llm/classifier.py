"""Quality classifier: supervised subword embeddings.

A token is the mean of learned vectors of its hashed word and of its hashed character n-grams;
two more learned vectors stand for word n-grams that repeat (a word after itself, a word 3-gram
that the text already had). A document is the mean over its tokens, and a softmax layer follows.
Trained by numpy stochastic gradient descent on a bounded sample of labelled documents. As the
softmax is linear in the mean, a trained model scores with one number per hashed feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import common

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIMENSION, EPOCHS, BATCH, RATE = 8, 5, 32, 2.0
#: Labelled documents per class that the fit reads at most (about; chosen by a seeded hash of the id).
MAX_PER_CLASS = 1200
#: Feature numbers of the two repetition marks, behind the hashed ones.
SAME, SEEN = BUCKETS, BUCKETS + 1


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) of the given words: the word itself and its byte n-grams within ``<word>``."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size + 2)])
    at = np.repeat(np.arange(len(size)), size + 2)
    place = np.arange(first[-1]) - first[at]
    letters = np.concatenate([data, np.frombuffer(b"<>", np.uint8)])
    source = np.where(place == 0, len(data), np.where(place > size[at], len(data) + 1, start[at] + place - 1))
    text = np.concatenate([letters[source].astype(np.uint64), np.zeros(max(GRAMS), np.uint64)])
    number, feature = [np.arange(len(size))], [(code % np.uint64(BUCKETS)).astype(np.int64)]
    packed = np.zeros(len(at), np.uint64)
    for k in range(max(GRAMS)):
        packed = packed | text[k : k + len(at)] << np.uint64(8 * k)
        if k + 1 in GRAMS:
            whole = place + k + 1 <= size[at] + 2
            number.append(at[whole])
            feature.append((common.mix(packed[whole] | np.uint64(k + 1) << np.uint64(56)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(number), np.concatenate(feature)


def _marks(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words equal the one before, and which end a word 3-gram that the document already had."""
    same, seen = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    if len(doc) > 2:
        same[1:] = (doc[1:] == doc[:-1]) & (code[1:] == code[:-1])
        key = common.mix(common.mix(common.mix(code[:-2] + doc[2:].astype(np.uint64)) ^ code[1:-1]) ^ code[2:])
        again = np.ones(len(key), bool)
        again[np.unique(key, return_index=True)[1]] = False
        seen[2:] = again & (doc[2:] == doc[:-2])
    return same, seen


def _mean(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    return values / np.maximum(n, 1)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_order, _label, text) to (_order, _label, features, weights): a document's mean as a sparse vector."""
    for batch in batches:
        for lo, hi, data, offsets in common.text_blocks(batch, 2, 1 << 18):
            n = hi - lo
            doc, start, end, code = common.words(data, offsets)
            tokens = np.bincount(doc, minlength=n)
            _, first, word = np.unique(code, return_index=True, return_inverse=True)
            number, feature = _features(data, start[first], end[first], code[first])
            order = np.argsort(number, kind="stable")
            number, feature = number[order], feature[order]
            each = np.bincount(number, minlength=len(first))
            begin = np.cumsum(each) - each
            pair, count = np.unique(doc * max(1, len(first)) + word, return_counts=True)
            pair_doc, pair_word = pair // max(1, len(first)), pair % max(1, len(first))
            times = each[pair_word]
            which = np.repeat(np.arange(len(pair)), times)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            long_doc = pair_doc[which]
            long_feature = feature[begin[pair_word[which]] + inner]
            weight = count[which] / times[which] / tokens[long_doc]
            docs, features, weights = [long_doc], [long_feature], [weight]
            for mark, flags in zip((SAME, SEEN), _marks(doc, code), strict=True):
                share = np.bincount(doc[flags], minlength=n) / np.maximum(tokens, 1)
                docs.append(np.flatnonzero(share))
                features.append(np.full(len(docs[-1]), mark))
                weights.append(share[docs[-1]])
            key, back = np.unique(np.concatenate(docs) * (BUCKETS + 2) + np.concatenate(features), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate(weights), minlength=len(key))
            ends = np.searchsorted(key // (BUCKETS + 2), np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, n), batch.column(1).slice(lo, n),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array((key % (BUCKETS + 2)).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(total.astype(np.float32))),
                ],
                ["_order", "_label", "features", "weights"],
            )
    common.give_back()


@dataclass
class Model:
    """One number per feature (by how much it speaks for label 1), and the bias."""

    table: np.ndarray
    bias: float


def train(features: list[np.ndarray], weights: list[np.ndarray], label: np.ndarray, share: np.ndarray, seed: int = 5) -> Model:
    """SGD on the softmax loss, in shuffled mini-batches with a falling rate.

    ``share`` weighs an example for the documents that it stands for.
    """
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (BUCKETS + 2, DIMENSION)).astype(np.float32)
    layer = random.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32)
    bias = np.log(np.array([(share * (label == c)).sum() + 1e-3 for c in (0, 1)], np.float32))
    steps = EPOCHS * -(-len(label) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            index = np.concatenate([features[i] for i in rows])
            value = np.concatenate([weights[i] for i in rows])
            row = np.repeat(np.arange(len(rows)), [len(features[i]) for i in rows])
            part = vectors[index] * value[:, None]
            mean = np.stack([np.bincount(row, weights=part[:, d], minlength=len(rows)) for d in range(DIMENSION)], 1)
            logits = mean @ layer + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(rows)), label[rows]] -= 1
            slope = chance * (share[rows] / share[rows].sum())[:, None]
            back = slope @ layer.T
            layer -= (rate * mean.T @ slope).astype(np.float32)
            bias -= (rate * slope.sum(0)).astype(np.float32)
            # Features are rare: their vectors take a step per example, not per batch.
            for d in range(DIMENSION):
                vectors[:, d] -= (rate * len(rows) * np.bincount(index, weights=value * back[row, d], minlength=BUCKETS + 2)).astype(np.float32)
    toward = layer[:, 1] - layer[:, 0]
    return Model((vectors @ toward).astype(np.float32), float(bias[1] - bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
    held_out: Column | None = None, max_per_class: int = MAX_PER_CLASS,
) -> Model:
    """A model from labelled documents for which ``held_out`` (on the labels' id) is not true.

    ``max_per_class`` bounds the sample of either class; labels other than 0 and 1, null ids and
    ids without a document are left out. Without both classes the model gives their prior share.
    """
    common.ship(docs.sparkSession)
    known = labels if held_out is None else labels.filter(~F.coalesce(held_out, F.lit(False)))
    known = known.select(common.named(id_col).alias("_id"), common.named(label).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IN (0, 1)")
    count = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    if len(count) < 2:
        rate = (count.get(1, 0) + 1) / (total + 2)
        return Model(np.zeros(BUCKETS + 2, np.float32), float(np.log(rate / (1 - rate))))
    # A threshold on a seeded hash: about max_per_class documents of either class, whatever the size.
    order = F.xxhash64(F.lit(11), "_id")
    limit = {c: min(2**63 - 1, int(2.0**63 * max_per_class / n)) for c, n in count.items()}
    chosen = known.withColumn("_order", order).filter(F.abs("_order") <= F.when(F.col("_label") == 0, F.lit(limit[0])).otherwise(F.lit(limit[1])))
    rows = docs.select(common.named(id_col).alias("_id"), common.text_of(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_order", "_label", "_text")
    bags = session.stage(rows.mapInArrow(_bags, "_order bigint, _label int, features array<int>, weights array<float>"), "bags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_, label_, features, weights = [], [], [], []
        for batch in batches:
            order_ += batch.column(0).to_pylist()
            label_ += batch.column(1).to_pylist()
            features += [x.values.to_numpy() for x in batch.column(2)]
            weights += [x.values.to_numpy() for x in batch.column(3)]
        if not order_:
            return
        place = np.argsort(np.array(order_), kind="stable")
        labels_ = np.array(label_)[place]
        have = np.bincount(labels_, minlength=2)
        share = np.array([count[c] / total / max(1, have[c]) for c in (0, 1)])[labels_]
        model = train([features[i] for i in place], [weights[i] for i in place], labels_, share)
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias])], ["table", "bias"])
        del features, weights
        common.give_back()

    found = bags.coalesce(1).mapInArrow(run, "table binary, bias double").collect()
    if not found:
        return Model(np.zeros(BUCKETS + 2, np.float32), float(np.log((count[1] + 1) / (count[0] + 1))))
    return Model(np.frombuffer(found[0]["table"], np.float32), found[0]["bias"])


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The chance of label 1 for each document of a block."""
    n = len(offsets) - 1
    doc, start, end, code = common.words(data, offsets)
    tokens = np.bincount(doc, minlength=n)
    _, first, word = np.unique(code, return_index=True, return_inverse=True)
    number, feature = _features(data, start[first], end[first], code[first])
    by_word = _mean(np.bincount(number, weights=model.table[feature], minlength=len(first)), np.bincount(number, minlength=len(first)))
    value = by_word[word] if len(first) else np.zeros(0)
    for mark, flags in zip((SAME, SEEN), _marks(doc, code), strict=True):
        value = value + flags * model.table[mark]
    logit = _mean(np.bincount(doc, weights=value, minlength=n), tokens) + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with ``out``, 0 to 1: how likely label 1 is. Null and empty texts get the bias alone."""
    common.ship(docs.sparkSession)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            table = pa.RecordBatch.from_arrays([batch], ["t"])
            yield pa.array(np.concatenate([np.zeros(0), *[scores(model, data, offsets) for _, _, data, offsets in common.text_blocks(table, 0, 1 << 19)]]))
        common.give_back()

    return docs.withColumn(out, F.arrow_udf(column, "double")(common.text_of(text)))


def held_out(id_col: str = "doc_id", modulus: int = 5) -> Column:
    """Documents that are never learned from: crc32 of the id's text is divisible by ``modulus``."""
    return F.coalesce(F.crc32(common.named(id_col).cast("string")) % modulus == 0, F.lit(False))
