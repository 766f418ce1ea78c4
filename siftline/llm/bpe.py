"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut by the pre-tokenizer's pattern. A piece that is itself in the vocabulary is found
by a minimal perfect hash (levels of bit arrays; a key's slot is the rank of its bit). Other
pieces are merged by a heap of pair ranks over linked byte ranges, in O(n log n) for any length.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import common

#: Pieces of a generation of memory; a worker remembers two of them.
REMEMBERED = 200_000


class PerfectHash:
    """Minimal perfect hash of byte strings: key i of the build gets a slot in 0..n-1 of its own."""

    def __init__(self, keys: list[bytes], spread: float = 1.6):
        self.n = len(keys)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        left = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        base = 0
        while len(left):
            size = max(64, int(spread * len(left)))
            place = self._place(left, len(self.levels), size)
            bits = np.bincount(place, minlength=size) == 1
            before = np.cumsum(bits) - bits
            self.levels.append((size, bits, before.astype(np.int32), base))
            base += int(bits.sum())
            left = left[~bits[place]]

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (common.mix(h ^ np.uint64((level + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; for a string that is no key, any slot or -1."""
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, (size, bits, before, base) in enumerate(self.levels):
            if not len(left):
                break
            place = self._place(h[left], level, size)
            hit = bits[place]
            out[left[hit]] = base + before[place[hit]]
            left = left[~hit]
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are their ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}


class Vocabulary:
    """Ranks of a byte-level BPE and its pre-tokenizer's pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(list(ranks))
        self.keys: list[bytes] = [b""] * len(ranks)
        for slot, key in zip(self.hash.slots(list(ranks)).tolist(), ranks, strict=True):
            self.keys[slot] = key
        self.ids = [ranks[k] for k in self.keys]
        #: Rank of every pair of bytes, -1 for those that are no token.
        self.pairs = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]

    def known(self, pieces: list[bytes]) -> list[int | None]:
        """First tier: the id of every piece that is a token itself."""
        return [self.ids[s] if s >= 0 and self.keys[s] == p else None for s, p in zip(self.hash.slots(pieces).tolist(), pieces, strict=True)]

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: merge the pair of least rank, the leftmost of equal ones, until none is left."""
        rank, n = self.ranks.get, len(piece)
        bits = (n + 1).bit_length()
        mask = (1 << bits) - 1
        # A part is the bytes from its start to end[start], where the next part starts; end is 0 inside
        # parts. An entry of the heap is one number: the pair's rank, its start, its end.
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r << bits | i) << bits | i + 2 for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False)) if (r := pairs[a << 8 | b]) >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            stop, i = entry & mask, entry >> bits & mask
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(piece[i : end[stop]])) is not None:
                    push(heap, (r << bits | i) << bits | end[stop])
            h = before[i]
            if h >= 0 and (r := rank(piece[h:stop])) is not None:
                push(heap, (r << bits | h) << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out


class Encoder:
    """Encodes texts; the ids of recent pieces are remembered, those not seen for a generation forgotten."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        # Ids as the bytes of 32-bit integers: those of a text are joined without a number being touched.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8") for p in pieces]
        for piece, data, one in zip(pieces, raw, self.vocabulary.known(raw), strict=True):
            self.young[piece] = array("i", (one,) if one is not None else self.vocabulary.merged(data)).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. New pieces of all of them are looked up together."""
        pieces = [self.find(t) for t in texts]
        distinct = set().union(*pieces)
        new = distinct.difference(self.young)
        if len(self.young) + len(new) > REMEMBERED:
            self.young, self.old, new = {}, self.young, distinct
        old = self.old
        self.young.update((p, old[p]) for p in new if p in old)
        self._learn([p for p in new if p not in old])
        find = self.young.__getitem__
        return [np.frombuffer(b"".join(map(find, p)), np.int32) for p in pieces]


class Decoder:
    """The bytes of all tokens, one after the other, and where each token's are."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.full(max(ranks.values(), default=0) + 1, -1, np.int64)
        by_id = sorted((i, token) for token, i in ranks.items())
        self.size[[i for i, _ in by_id]] = [len(token) for _, token in by_id]
        self.data = np.frombuffer(b"".join(token for _, token in by_id) or b" ", np.uint8)
        self.start = np.cumsum(np.maximum(self.size, 0)) - self.size

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The bytes of each id list, of which ``counts`` gives the lengths."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or self.size[ids].min() < 0):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(self.start[ids] - total[:-1], size) + np.arange(total[-1])]
        offsets = total[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
        return whole.cast(pa.binary())


_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per process; the file is installed on every machine and never changes."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary(read_ranks(path), pattern))
    return _encoders[path, pattern]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(read_ranks(path))
    return _decoders[path]


def _chunks(texts: pa.Array, most: int = 1 << 18) -> Iterator[list[str]]:
    """Consecutive texts, about ``most`` characters at once."""
    held: list[str] = []
    size = 0
    for one in texts:
        held.append(one.as_py())
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """The rows with an array of token ids of their text (a null text counts as empty: no ids).

    With ``decoded``, a column of that name has the bytes that the ids give back, worked out from the
    ids in the same pass. No special tokens; pieces are encoded one by one. Documents of any length are
    taken whole, repeated rows stay, an empty table gives an empty one. Columns called like ``out`` or
    ``decoded`` are replaced; rows and other columns stay as they are.
    """

    common.ship(docs.sparkSession)
    kind = "array<int>" if decoded is None else "struct<ids:array<int>,bytes:binary>"

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(path, pattern)
        for batch in batches:
            each = [one for texts in _chunks(batch) for one in coder.encode(texts)]
            counts = np.array([len(one) for one in each], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *each])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
            if decoded is None:
                yield ids
            else:
                yield pa.StructArray.from_arrays([ids, decoder(path).decode(flat, counts)], ["ids", "bytes"])
        common.give_back()

    coded = F.arrow_udf(column, kind)(common.text_of(text))
    if decoded is None:
        return docs.withColumn(out, coded)
    own = f"_{out}_{decoded}"
    kept = [common.named(c) for c in docs.columns if c not in (out, decoded)]
    return docs.withColumn(own, coded).select(*kept, F.col(f"`{own}`.ids").alias(out), F.col(f"`{own}`.bytes").alias(decoded))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids (null for a null array). An unknown or null id fails the job."""

    common.ship(rows.sparkSession)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            found = decoder(path).decode(flat.to_numpy(zero_copy_only=False), counts)
            yield pc.if_else(batch.is_null(), pa.scalar(None, pa.binary()), found) if batch.null_count else found
        common.give_back()

    return rows.withColumn(out, F.arrow_udf(column, "binary")(common.named(ids)))


def joined(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
