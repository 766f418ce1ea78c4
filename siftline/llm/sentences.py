"""SentencePiece BPE encoding and decoding by a table of distinct chunks.

White space becomes a marker, and a text is cut before every run of markers. When no piece of the
model has a marker behind another character, no merge crosses such a cut, so chunks ("marked words")
are segmented on their own. The texts of a block are one array of code points: its chunks are
numbered by content, each distinct one is segmented once, all together (one merge of every chunk per
step, the pair of best score, the leftmost of equal ones), and the ids are joined back to the places
of the chunks by gathers. Nothing is kept from block to block, so memory is bounded by a block.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import common
from siftline.llm.token_counts import _fields

MARK = 0x2581
#: Characters that a block holds (a longer text is a block of its own).
BLOCK_CHARS = 1 << 20
#: Chunks up to these lengths are segmented together, padded to that width; longer ones by a heap.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32)
NONE = np.int32(2**31 - 1)
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_PLACE = np.random.default_rng(20250307).integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)


def _single_bytes(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("siftline-bytes", _single_bytes)


class Model:
    """Pieces of a BPE model with byte fallback, as tables over symbol numbers.

    A symbol's number is its piece's id; characters that occur in pieces but are none
    themselves are numbered behind them, and any other character is ``-2 - code point``.
    """

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        trainer = dict(_fields(b"".join(v for n, v in fields if n == 2)))
        normalizer = dict(_fields(b"".join(v for n, v in fields if n == 3)))
        pieces = [dict(_fields(v)) for n, v in fields if n == 1]
        names = [p[1].decode("utf-8") for p in pieces]
        kinds = np.array([p.get(3, _NORMAL) for p in pieces])
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only BPE models with byte fallback and markers in front of words")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that keep texts as they are, with white space as markers")
        if not set(kinds.tolist()) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("no models with unused or user-defined pieces")
        self.prefix = bool(normalizer.get(3, 1))
        self.kinds, self.size = kinds, len(names)
        self.unknown = trainer.get(44, " ⁇ ".encode()).decode("utf-8")
        self.number = {name: i for i, name in enumerate(names) if kinds[i] == _NORMAL}
        mark = chr(MARK)
        #: Whether a chunk can be segmented alone; else a text is one chunk.
        self.separable = all(mark not in name.lstrip(mark) for name in self.number)
        self._merges([-float(p.get(2, 0.0)) for p in pieces])
        self.byte_ids = np.zeros(256, np.int32)
        shown = []
        for i, name in enumerate(names):
            if kinds[i] == _BYTE:
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                shown.append(bytes([value]))
            else:
                shown.append(name.replace(mark, " ").encode("utf-8") if kinds[i] == _NORMAL else b"")
        self.marked = np.array([kinds[i] == _NORMAL and name.startswith(mark) for i, name in enumerate(names)], bool)
        self.shown = np.frombuffer(b"".join(shown) or b" ", np.uint8)
        self.shown_size = np.array([len(s) for s in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size

    def _merges(self, cost: list[float]) -> None:
        """Pairs of symbols that join to a piece: sorted keys, the piece's id, its place by score."""
        number = dict(self.number)
        for name in self.number:
            for char in name:
                number.setdefault(char, self.size + len(number) - len(self.number))
        self.symbols = self.size + len(number) - len(self.number)
        place = {c: i for i, c in enumerate(sorted({cost[i] for i in self.number.values()}))}
        pairs = {}
        for name, i in self.number.items():
            for cut in range(1, len(name)):
                left, right = number.get(name[:cut]), number.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left * self.symbols + right] = (i, place[cost[i]])
        keys = sorted(pairs)
        self.keys = np.array(keys or [-1], np.int64)
        self.joined = np.array([pairs[k][0] for k in keys] or [0], np.int32)
        self.place = np.array([pairs[k][1] for k in keys] or [NONE], np.int32)
        self.of_char = -2 - np.arange(0x110000, dtype=np.int32)
        self.char_of = np.zeros(self.symbols, np.int64)
        for name, i in number.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
                self.char_of[i] = ord(name)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place by score or NONE, piece) of pairs of symbols."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.place[at], NONE), self.joined[at]

    # --- segmentation of distinct chunks ---

    def segment(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count): chunk i has the ids ``ids[first[i] : first[i] + count[i]]``."""
        symbols = self.of_char[chars]
        count, chunk, parts = np.zeros(len(start), np.int64), [], []
        low = 0
        for width in WIDTHS:
            these = np.flatnonzero((size > low) & (size <= width))
            low = width
            for block in np.array_split(these, max(1, -(-len(these) * width // BLOCK_CHARS))):
                if len(block):
                    rows = self._together(symbols, start[block], size[block], width)
                    here = rows != -1
                    chunk.append(np.repeat(block, here.sum(1)))
                    parts.append(rows[here])
        for i in np.flatnonzero(size > low).tolist():
            parts.append(self._alone(symbols[start[i] : start[i] + size[i]]))
            chunk.append(np.full(len(parts[-1]), i))
        ids = np.concatenate([np.zeros(0, np.int32), *parts])
        of = np.concatenate([np.zeros(0, np.int64), *chunk]).astype(np.int64)
        ids, of = self._in_bytes(ids, of)
        count = np.bincount(of, minlength=len(start)).astype(np.int64)
        # Chunks come one after the other, so a chunk's ids begin where it is first seen.
        first = np.zeros(len(start), np.int64)
        edge = np.flatnonzero(np.diff(of, prepend=-1))
        first[of[edge]] = edge
        return ids, first, count

    def _together(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """Symbols of chunks of similar length, a row each, padded with -1; all merge once per step."""
        column = np.arange(width)
        inside = column < size[:, None]
        rows = np.where(inside, symbols[np.minimum(start[:, None] + column, len(symbols) - 1)], -1).astype(np.int32)
        out = rows.copy()
        place, piece = self.look(rows[:, :-1], rows[:, 1:])
        live = np.arange(len(rows))
        while len(live):
            at = place.argmin(1)
            line = np.arange(len(live))
            more = place[line, at] < NONE
            if not more.all():
                out[live[~more]] = rows[~more]
                live, rows, place, piece, at = live[more], rows[more], place[more], piece[more], at[more]
                line = line[: len(live)]
                if not len(live):
                    break
            rows[line, at] = piece[line, at]
            # The symbol behind the pair goes: everything further right moves up by one.
            take = column[:-1] + (column[:-1] > at[:, None])
            rows[:, :-1] = np.take_along_axis(rows, take, 1)
            rows[:, -1] = -1
            if width > 2:
                place[:, :-1] = np.take_along_axis(place, take[:, :-1], 1)
                piece[:, :-1] = np.take_along_axis(piece, take[:, :-1], 1)
            place[:, -1] = NONE
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                p, j = self.look(rows[ok, side[ok]], rows[ok, side[ok] + 1])
                place[ok, side[ok]], piece[ok, side[ok]] = p, j
        return out

    def _alone(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of one long chunk, merged by a heap over linked places."""
        value, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        place, piece = (x.tolist() for x in self.look(symbols[:-1], symbols[1:]))
        heap = [(p, i, value[i], value[i + 1], j) for i, (p, j) in enumerate(zip(place, piece, strict=True)) if p < NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        gone = [False] * n

        def push(i: int) -> None:
            j = after[i]
            if i < 0 or j >= n or value[i] < 0 or value[j] < 0:
                return
            pair = (value[i], value[j])
            if pair not in known:
                p, m = self.look(np.array(pair[:1]), np.array(pair[1:]))
                known[pair] = (int(p[0]), int(m[0]))
            if known[pair][0] < NONE:
                heapq.heappush(heap, (known[pair][0], i, *pair, known[pair][1]))

        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or value[i] != left or value[j] != right:
                continue
            value[i], gone[j], after[i] = joined, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return np.array([v for v, g in zip(value, gone, strict=True) if not g], np.int32)

    def _in_bytes(self, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no pieces become the ids of their bytes."""
        odd = np.flatnonzero((ids < 0) | (ids >= self.size))
        if not len(odd):
            return ids, of
        times = np.ones(len(ids), np.int64)
        raw = []
        for i in odd.tolist():
            raw.append(chr(int(self.char_of[ids[i]] if ids[i] >= 0 else -2 - ids[i])).encode("utf-8"))
            times[i] = len(raw[-1])
        spread = np.repeat(np.isin(np.arange(len(ids)), odd), times)
        out, of = np.repeat(ids, times), np.repeat(of, times)
        out[spread] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, of

    # --- texts ---

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        lead = chr(MARK) if self.prefix else ""
        whole = "".join(lead + t for t in texts if t)
        sizes = np.array([len(t) + len(lead) if t else 0 for t in texts], np.int64)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        chars[chars == 0x20] = MARK
        ends = np.cumsum(sizes)
        begins = np.zeros(len(chars) + 1, bool)
        begins[ends - sizes] = True
        begins[-1] = False
        if self.separable:
            mark = chars == MARK
            begins[:-1] |= mark & ~np.concatenate([[False], mark[:-1]])
        start = np.flatnonzero(begins)
        size = np.diff(start, append=len(chars))
        code, distinct = distinct_chunks(chars, start, size)
        ids, first, count = self.segment(chars, start[distinct], size[distinct])
        # Join the ids back by position.
        each = count[code]
        total = np.cumsum(each)
        out = ids[np.repeat(first[code] - (total - each), each) + np.arange(int(total[-1]))]
        before = np.concatenate([[0], total])[np.searchsorted(start, np.concatenate([[0], ends]))]
        return out, np.diff(before)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of id lists; the first marker of a text goes when the model puts one in front."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the model")
        ends = np.cumsum(counts)
        if np.isin(self.kinds[ids], (_UNKNOWN, _CONTROL)).any():
            return pa.array([self._decode_one(ids[e - n : e].tolist()) for n, e in zip(counts, ends, strict=True)], pa.string())
        size, start = self.shown_size[ids], self.shown_start[ids]
        heads = (ends - counts)[counts > 0]
        if self.prefix:
            cut = heads[self.marked[ids[heads]]]
            size[cut] -= 1
            start[cut] += 1
        total = np.cumsum(size)
        data = self.shown[np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
        offsets = np.concatenate([[0], total])[np.concatenate([[0], ends])].astype(np.int64)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([self._decode_one(ids[e - n : e].tolist()) for n, e in zip(counts, ends, strict=True)], pa.string())

    def _decode_one(self, ids: list[int]) -> str:
        out, raw, strip = [], bytearray(), self.prefix
        for i in ids:
            kind = self.kinds[i]
            if kind == _BYTE:
                raw += self.shown[self.shown_start[i] : self.shown_start[i] + 1].tobytes()
                continue
            if raw:
                out.append(raw.decode("utf-8", "siftline-bytes"))
                raw.clear()
            strip = strip and not any(out)
            text = self.unknown if kind == _UNKNOWN else ""
            if kind == _NORMAL:
                text = self.shown[self.shown_start[i] : self.shown_start[i] + self.shown_size[i]].tobytes().decode("utf-8")
                if strip and self.marked[i]:
                    text, strip = text[1:], False
            out.append(text)
        out.append(raw.decode("utf-8", "siftline-bytes"))
        return "".join(out)


def distinct_chunks(chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each chunk's content, a chunk that has the content of each number).

    Contents are told apart by 64-bit hashes from prefix sums, then compared in full: a chunk
    that only shares its hash gets a number of its own.
    """
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(common.mix(chars.astype(np.uint64) + _PLACE[0]) * common.powers(common._BASE, len(chars))[: len(chars)], out=sums[1:])
    end = start + size
    key = common.mix((sums[end] - sums[start]) * common.powers(common._INVERSE, len(chars) + 1)[start] + size.astype(np.uint64))
    _, distinct, code = np.unique(key, return_index=True, return_inverse=True)
    model = distinct[code]
    same_size = size == size[model]
    shift = np.repeat(start[model] - start, size)
    place = np.arange(len(chars))
    differs = chars[place] != chars[np.clip(place + shift, 0, len(chars) - 1)]
    wrong = np.flatnonzero((np.add.reduceat(differs, start) > 0) | ~same_size) if len(start) else start
    if len(wrong):
        code[wrong] = len(distinct) + np.arange(len(wrong))
        distinct = np.concatenate([distinct, wrong])
    return code, distinct


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """Read once per process; the file is installed on every machine and never changes."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for one in texts:
        held.append(one.as_py())
        size += len(held[-1]) + 1
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """The rows with the ids of their text, without begin and end; a null or empty text has none.

    With ``decoded``, a column of that name has the text that the ids give back, worked out from
    the ids in the same pass. Texts of any length are taken whole; repeated rows stay, an empty
    table gives an empty one, and columns called like ``out`` or ``decoded`` are replaced. Nothing
    is shuffled, so a lost task is run again from its input alone.
    """
    common.ship(docs.sparkSession)
    kind = "array<int>" if decoded is None else "struct<ids:array<int>,text:string>"

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for batch in batches:
            coded = [m.encode(texts) for texts in _blocks(batch)]
            counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in coded]])
            ids = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(0, np.int32), *[i for i, _ in coded]])),
            )
            if decoded is None:
                yield ids
            else:
                back = pa.concat_arrays([pa.array([], pa.string()), *[m.decode(i, c) for i, c in coded]])
                yield pa.StructArray.from_arrays([ids, back], ["ids", "text"])
        common.give_back()

    coded = F.arrow_udf(column, kind)(common.text_of(text))
    if decoded is None:
        return docs.withColumn(out, coded)
    own = f"_{out}_{decoded}"
    kept = [common.named(c) for c in docs.columns if c not in (out, decoded)]
    return docs.withColumn(own, coded).select(*kept, F.col(f"`{own}`.ids").alias(out), F.col(f"`{own}`.text").alias(decoded))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """The rows with the text of their ids: null for a null list, '' for an empty one.

    Control pieces give nothing, an unknown piece its surface, bytes that are no UTF-8 a
    replacement character each. An id that the model does not have, or a null in a list, fails the job.
    """
    common.ship(rows.sparkSession)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            texts = m.decode(flat.to_numpy(zero_copy_only=False), counts)
            yield pc.if_else(batch.is_null(), pa.scalar(None, pa.string()), texts) if batch.null_count else texts
        common.give_back()

    return rows.withColumn(out, F.arrow_udf(column, "string")(common.named(ids)))
