"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by workers.

Counting: tasks turn words into 64-bit hashes, count n-grams in blocks of tokens, and send them,
as arrays, to buckets by the hash of their context. A bucket's task adds the counts up, sums the
statistics of its contexts, writes both as sorted hash arrays into the shared folder, and passes
the suffixes of its distinct n-grams on, from which the next lower order gets its continuation
counts. The number of buckets follows the size of the text, so a bucket's size does not.

Scoring: workers map the arrays of the shared folder and look up sorted queries.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import common

BEGIN, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Tokens that a counting task holds before it sends their n-grams on.
FLUSH_TOKENS = 1_500_000
#: Tokens that are scored at once.
SCORE_TOKENS = 400_000
#: Text bytes per bucket of n-grams.
BUCKET_BYTES = 8 << 20


def _joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mix(context ^ word * _STEP)


def _context(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the words of a context (one column for each of its places)."""
    out = columns[0]
    for word in columns[1:]:
        out = _joined(out, word)
    return out


def _bucket(context: np.ndarray, buckets: int) -> np.ndarray:
    return ((common.mix(context) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def tokens(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes, where each document's tokens begin), about ``most`` tokens at once.

    A-Z count as a-z; every document ends with one end token.
    """
    table, held, lo_row = common.folded(), [], 0
    size = 0

    def out(hi: int):
        lengths = np.concatenate([x[0] for x in held])
        begin = np.concatenate([[0], np.cumsum(lengths)])
        return lo_row, hi, np.concatenate([x[1] for x in held]), begin

    for lo, hi, data, offsets in common.text_blocks(batch, column):
        doc, _, _, code = common.words(data, offsets, table)
        n = hi - lo
        lengths = np.bincount(doc, minlength=n) + 1
        begin = np.cumsum(lengths) - lengths
        all_ = np.full(int(lengths.sum()), END, np.uint64)
        all_[np.arange(len(doc)) + doc] = code  # an end token before each later document
        held.append((lengths, all_))
        size += len(all_)
        if size >= most:
            yield out(hi)
            held, lo_row, size = [], hi, 0
    if held:
        yield out(batch.num_rows)


def ngrams(code: np.ndarray, begin: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends in each token, by place; begin marks stand before a document."""
    place = np.arange(len(code)) - np.repeat(begin[:-1], np.diff(begin))
    columns = [code]
    for back in range(1, order):
        word = np.full(len(code), BEGIN, np.uint64)
        has = place >= back
        word[has] = code[np.flatnonzero(has) - back]
        columns.insert(0, word)
    return columns


def _summed(columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of ``columns`` in the order of the first column, with their counts added up."""
    key = _joined(_context(columns[:-1]), columns[-1]) if len(columns) > 1 else columns[0]
    order = np.lexsort((key, columns[0])) if len(columns) > 1 else np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return columns, counts
    return [c[order][first] for c in columns], [np.add.reduceat(c[order], first) for c in counts]


def _pack(columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Arrays as bytes; the sorted first column as its distinct values and their runs."""
    head = columns[0]
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    runs = np.diff(np.append(first, len(head))).astype(np.uint32)
    small = [c.astype(np.uint32) if len(c) and c.max() < 2**32 else c for c in counts]
    return pickle.dumps((head[first], runs, columns[1:], small), protocol=5)


def _unpack(blobs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = [pickle.loads(b) for b in blobs]
    columns = [np.concatenate([np.repeat(p[0], p[1]) for p in parts])]
    columns += [np.concatenate([p[2][i] for p in parts]) for i in range(len(parts[0][2]))]
    return columns, [np.concatenate([p[3][i].astype(np.int64) for p in parts]) for i in range(len(parts[0][3]))]


def _sent(columns: list[np.ndarray], counts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows (bucket, blob) of n-grams, by the bucket of their context."""
    which = _bucket(_context(columns[:-1] or columns), buckets)
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(buckets + 1))
    rows = [(b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]
    blobs = [_pack([c[at] for c in columns], [c[at] for c in counts]) for _, at in rows]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _counter(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, _, code, begin in tokens(batch, 0, FLUSH_TOKENS // 4):
                held.append(ngrams(code, begin, order))
                size += len(code)
                if size >= FLUSH_TOKENS:
                    yield _flushed(held, order, buckets)
                    held, size = [], 0
        if held:
            yield _flushed(held, order, buckets)
        held = []
        common.give_back()

    return run


def _flushed(held: list[list[np.ndarray]], order: int, buckets: int) -> pa.RecordBatch:
    columns = [np.concatenate([h[i] for h in held]) for i in range(order)]
    columns, counts = _summed(columns, [np.ones(len(columns[0]), np.int64)])
    return _sent(columns, counts * 2, buckets)


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """A task that runs twice writes the same file; the name appears when the file is whole."""
    part = f"{folder}/{name}.{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, f"{folder}/{name}")


def _level(level: int, buckets: int, folder: str):
    """Adds up a bucket of n-grams of one order, writes its arrays, sends the suffixes on."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        columns, (raw, seen) = _unpack(table.column("blob").to_pylist())
        columns, (raw, seen) = _summed(columns, [raw, seen])
        context = _context(columns[:-1]) if level > 1 else np.zeros(len(seen), np.uint64)
        key = _joined(context, columns[-1]) if level > 1 else columns[0]
        order = np.argsort(key)
        _write(folder, f"{level}-{bucket}.key", key[order])
        count = seen[order]
        _write(folder, f"{level}-{bucket}.n", np.minimum(count, 255).astype(np.uint8))
        _write(folder, f"{level}-{bucket}.many", np.stack([key[order][count >= 255], count[count >= 255].astype(np.uint64)]) if (count >= 255).any() else np.zeros(0, np.uint64))
        if level == 1:
            _write(folder, f"{level}-{bucket}.raw", raw[order])
        else:
            contexts, which = np.unique(context, return_inverse=True)
            total = np.bincount(which, weights=seen, minlength=len(contexts))
            stats = [np.bincount(which, weights=test, minlength=len(contexts)) for test in (seen == 1, seen == 2, seen > 2)]
            _write(folder, f"{level}-{bucket}.context", contexts)
            _write(folder, f"{level}-{bucket}.stats", np.stack([total, *stats], 1).astype(np.float64))
        facts = [int((seen == i).sum()) for i in (1, 2, 3, 4)] + [len(seen), int(seen.sum()), int(raw.sum())]
        del key, order, count
        common.give_back()
        out = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pickle.dumps(facts)], pa.binary())], ["bucket", "blob"])
        if level == 1:
            return pa.Table.from_batches([out])
        # A distinct n-gram is one continuation of its suffix.
        lower = _summed(columns[1:], [raw, np.ones(len(raw), np.int64)])
        return pa.Table.from_batches([out, _sent(*lower, buckets)])

    return run


@dataclass
class Model:
    folder: str
    order: int
    buckets: int
    #: By level, from 1: D1, D2, D3+.
    discounts: list[tuple[float, float, float]]
    #: Of level 1: types with 1, 2, more continuations, all types, all continuations, all tokens.
    unigram: tuple[int, int, int, int, int, int]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """The closed form of modified Kneser-Ney; constants where counts of counts are missing."""
    if min(n) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))  # type: ignore[return-value]


def fit(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Counts all n-grams of ``docs`` up to ``order`` (2 or more). A null text is an empty one."""
    spark = docs.sparkSession
    common.ship(spark)
    texts = docs.select(common.text_of(text).alias("_text"))
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = common.parts(size, BUCKET_BYTES)
    folder = common.mapped_folder(spark, "lm")
    rows = texts.mapInArrow(_counter(order, buckets), "bucket int, blob binary")
    discounts, facts = [], [0] * 7
    for level in range(order, 0, -1):
        done = rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_level(level, buckets, folder), "bucket int, blob binary")
        done = session.stage(done, f"lm-{level}")
        found = done.filter("bucket = -1").select("blob").toLocalIterator()  # a few numbers per bucket
        facts = [sum(x) for x in zip([0] * 7, *(pickle.loads(r["blob"]) for r in found), strict=True)]
        discounts.insert(0, _discounts(facts[:4]))
        rows = done.filter("bucket >= 0")
    ones, twos, types = facts[0], facts[1], facts[4]
    return Model(folder, order, buckets, discounts, (ones, twos, types - ones - twos, types, facts[5], facts[6]))


class Lookup:
    """The model's arrays, mapped; opened once per worker."""

    def __init__(self, model: Model):
        self.model = model
        self.open: dict[tuple[int, int, str], np.ndarray] = {}

    def array(self, level: int, bucket: int, name: str, kind) -> np.ndarray:
        at = level, bucket, name
        if at not in self.open:
            path = f"{self.model.folder}/{level}-{bucket}.{name}"
            if not os.path.exists(path) or not os.path.getsize(path):
                self.open[at] = np.zeros(0, kind)
            else:
                self.open[at] = np.memmap(path, kind, "r")
        return self.open[at]

    def _spread(self, bucket: np.ndarray, query: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.lexsort((query, bucket))
        ends = np.searchsorted(bucket[order], np.arange(self.model.buckets + 1))
        for b in range(self.model.buckets):
            if ends[b] < ends[b + 1]:
                yield b, order[ends[b] : ends[b + 1]]

    @staticmethod
    def _find(keys: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which queries are keys, where) for sorted keys and queries."""
        at = np.searchsorted(keys, query)
        at[at == len(keys)] = 0
        return np.asarray(keys[at] == query) if len(keys) else np.zeros(len(query), bool), at

    def counts(self, level: int, bucket: np.ndarray, key: np.ndarray, raw: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        for b, at in self._spread(bucket, key):
            hit, where = self._find(self.array(level, b, "key", np.uint64), key[at])
            at, where = at[hit], where[hit]
            found = self.array(level, b, "n", np.uint8)[where].astype(np.int64)
            many = self.array(level, b, "many", np.uint64)
            if len(many) and (big := found == 255).any():
                pairs = many.reshape(2, -1)
                found[big] = pairs[1][np.searchsorted(pairs[0], key[at[big]])]
            out[at] = found
            if raw is not None:
                raw[at] = self.array(level, b, "raw", np.int64)[where]
        return out

    def contexts(self, level: int, bucket: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Total and number of types seen once, twice, more often after each context."""
        out = np.zeros((len(context), 4))
        for b, at in self._spread(bucket, context):
            hit, where = self._find(self.array(level, b, "context", np.uint64), context[at])
            if hit.any():
                out[at[hit]] = self.array(level, b, "stats", np.float64).reshape(-1, 4)[where[hit]]
        return out

    def probabilities(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each token after its history, its raw count in the training text)."""
        m = self.model
        word = columns[-1]
        raw = np.zeros(len(word), np.int64)
        ones, twos, more, types, total, _ = m.unigram
        seen = self.counts(1, _bucket(word, m.buckets), word, raw)
        d = np.array([0.0, *m.discounts[0]])
        left = d[1] * ones + d[2] * twos + d[3] * more
        p = (np.maximum(seen - d[np.minimum(seen, 3)], 0) + left / (types + 1)) / total if total else np.full(len(word), 1 / (types + 1))
        for level in range(2, m.order + 1):
            context = _context(columns[-level:-1])
            bucket = _bucket(context, m.buckets)
            seen = self.counts(level, bucket, _joined(context, word))
            stats = self.contexts(level, bucket, context)
            d = np.array([0.0, *m.discounts[level - 1]])
            left = stats[:, 1:] @ d[1:]
            known = stats[:, 0] > 0
            q = (np.maximum(seen - d[np.minimum(seen, 3)], 0) + left * p) / np.where(known, stats[:, 0], 1)
            p = np.where(known, q, p)
        return p, raw


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "lm") -> DataFrame:
    """The rows with a struct ``out``: ``n_tokens``, ``n_known``, ``base_score``, ``score``, ``perplexity``.

    Scores are log10 probabilities of the text with its end. A null or empty text is its end token
    alone. Tokens never seen get their share of the uniform distribution below the unigrams.
    """
    common.ship(docs.sparkSession)
    fields = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())]

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lookup = Lookup(model)
        types, total = model.unigram[3], model.unigram[5]
        for batch in batches:
            parts: list[list[np.ndarray]] = [[np.zeros(0, t.to_pandas_dtype())] for _, t in fields]
            for _, _, code, begin in tokens(pa.RecordBatch.from_arrays([batch], ["t"]), 0, SCORE_TOKENS):
                p, raw = lookup.probabilities(ngrams(code, begin, model.order))
                n = np.diff(begin)
                log = np.add.reduceat(np.log10(p), begin[:-1])
                base = np.add.reduceat(np.log10((raw + 1) / (total + types + 1)), begin[:-1])
                for part, value in zip(parts, (n, np.add.reduceat((raw > 0).astype(np.int64), begin[:-1]), base, log, 10 ** (-log / n)), strict=True):
                    part.append(value)
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=[n for n, _ in fields])
        lookup.open.clear()
        common.give_back()

    kind = "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double,perplexity:double>"
    return docs.withColumn(out, F.arrow_udf(column, kind)(common.text_of(text)))


def held_out(id_col: str = "doc_id", modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(common.named(id_col).cast("string")) % modulus == remainder, F.lit(False))
