"""Suffix-array deduplication by external induced sorting.

A shard is what meets at the anchors of one bucket (see ``repeats``). Its suffixes are sorted by
induction: the suffixes that begin at local minima (LMS) are put in order first, by naming their
substrings (sorted by induction, too; those of bytes by comparing seven units at once) and recursing on the names until all differ; from their order that of all others
follows, bucket by bucket. The queues between buckets are monotone priority queues: entries leave
in the order of their first unit, then of the suffix that induced them; beyond ``memory`` entries
they are written to disk as runs, and read back when their bucket comes. Neighbours in suffix
order that have ``length`` bytes in common form a class, and all of a class but the smallest
document's windows are repeats.
"""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import common, repeats

BYTES = repeats.Shape("byte", 50, 24, 3 << 19)
#: Entries that the queues of one sort hold in memory.
MEMORY = 8_000_000
_END, _BREAK = 0, 1


class Queue:
    """Entries that leave range by range of their keys, first in first out among equal keys.

    A monotone priority queue: what is pushed has keys beyond the range that has left last. Beyond
    ``memory`` entries, all that wait are written to disk, and read when their range leaves.
    """

    def __init__(self, edges: np.ndarray, memory: int, folder: str | None):
        self.edges, self.memory, self.folder = edges, memory, folder
        self.waiting: list[list[np.ndarray]] = [[] for _ in edges[1:]]
        self.written: dict[int, list[tuple[int, int]]] = {}
        self.file = None
        self.held = 0

    def push(self, keys: np.ndarray, entries: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        cut = np.searchsorted(keys[order], self.edges)
        for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            self.waiting[i].append(entries[order[cut[i] : cut[i + 1]]])
        self.held += len(entries)
        if self.held > self.memory:
            self._write()

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(0, 2)
        for i, chunks in enumerate(self.waiting):
            if chunks:
                entries = np.concatenate(chunks)
                self.written.setdefault(i, []).append((self.file.tell(), len(entries)))
                self.file.write(entries.tobytes())
                self.waiting[i] = []
        self.held = 0

    def pop(self, i: int) -> np.ndarray:
        """The entries of range ``i``, in the order of their pushes; equal keys are in their order."""
        chunks = []
        for at, n in self.written.pop(i, ()):
            self.file.seek(at)
            chunks.append(np.frombuffer(self.file.read(8 * n), np.int64))
        chunks += self.waiting[i]
        self.held -= sum(map(len, self.waiting[i]))
        self.waiting[i] = []
        return np.concatenate(chunks) if chunks else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _ranges(keys: np.ndarray, most: int) -> np.ndarray:
    """Edges of ranges of keys with a fair share of the suffixes each (a frequent key is its own)."""
    count = np.cumsum(np.bincount(keys))
    parts = int(min(most, max(1, len(keys) // 4000)))
    edges = np.searchsorted(count, count[-1] * np.arange(1, parts) / parts, "left") + 1
    heavy = np.flatnonzero(np.diff(count, prepend=0) > count[-1] / parts / 2)
    return np.unique(np.concatenate([[0], edges, heavy, heavy + 1, [len(count)]]))


def _sweep(key: np.ndarray, induced: np.ndarray, seeds: np.ndarray, memory: int, folder: str | None, most: int = 200) -> np.ndarray:
    """Suffixes of one type in order, each induced by the suffix one place on.

    ``seeds`` are the suffixes of the other type, in order; ``induced[p]`` tells the type asked for,
    whose keys are never below those of the suffix behind. Suffixes with one key are in the order of
    those that induced them, before the seeds with that key. A range of keys is worked on at once:
    what it induces within itself is put in place by ranking entries by key and inducer until the
    longest chain of inductions is settled.
    """
    edges = _ranges(key, most)
    none = int(key.max()) + 1
    # The key of a suffix that can be induced; the end mark cannot, and stands for what is before the first suffix.
    step = np.where(induced, key, none).astype(np.uint16 if none < 1 << 16 else np.int64)
    step[-1] = none
    queue = Queue(edges, memory, folder)
    cut = np.searchsorted(key[seeds], edges)
    out = []
    for i, (low, high) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        waited = queue.pop(i)
        own = seeds[cut[i] : cut[i + 1]]
        if not len(waited) + len(own):
            continue
        if high - low == 1:  # one key: what is induced into it comes in the order of the inducers, and seeds induce none
            rounds, steps = [waited], [step[waited - 1]]
            while len(at := rounds[-1][steps[-1] < high]):
                rounds.append(at - 1)
                steps.append(step[at - 2])
            out += rounds
            place, to = np.concatenate([*rounds, own]), np.concatenate([*steps, step[own - 1]])
        else:
            place = np.concatenate([waited[np.argsort(key[waited], kind="stable")], own])
            place, to, kind = _settled(key, step, place, len(waited), high)
            out.append(place[kind < 2])
        beyond = (to >= high) & (to < none)
        queue.push(to[beyond], place[beyond] - 1)
    queue.close()
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _settled(key: np.ndarray, step: np.ndarray, place: np.ndarray, waited: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, keys of those they induce, kinds: 0 waited, 1 induced within the range, 2 seeds) of a range of keys."""
    base = len(place)
    kind = np.repeat(np.array([0, 2], np.int64), [waited, base - waited])
    inducer = np.arange(base)
    to = step[place - 1]
    levels, at = 0, np.flatnonzero(to < high)
    while len(at):  # entries that are induced into this very range
        levels += 1
        new, n = place[at] - 1, len(place)
        place, kind, inducer = np.concatenate([place, new]), np.concatenate([kind, np.ones(len(at), np.int64)]), np.concatenate([inducer, at])
        to = np.concatenate([to, step[new - 1]])
        at = n + np.flatnonzero(to[n:] < high)
    first = key[place] if not levels else key[place] * np.int64(3) + kind
    if levels:
        rank = first * np.int64(len(place)) + np.arange(len(place))
        among = np.arange(len(place) - base)
        for _ in range(levels):
            order = np.lexsort((rank[inducer[base:]], first[base:]))
            among[order] = np.arange(len(order))
            rank[base:] = first[base:] * np.int64(len(place)) + among
        settled = np.concatenate([np.arange(base), base + order])
        place, to, kind, first = place[settled], to[settled], kind[settled], first[settled]
    order = np.argsort(first, kind="stable")
    return place[order], to[order], kind[order]


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, memory: int, folder: str | None) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order (or, of those in any order, by LMS substrings).

    ``smaller`` tells the suffixes that are less than the next one (type S).
    """
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    larger = _sweep(text, ~smaller, seeds, memory, folder)
    falling = _sweep(text.max() - text, smaller, larger[::-1], memory, folder)
    # The end mark is type S with nothing behind it to induce it.
    both = np.concatenate([[len(text) - 1], larger, falling[::-1]])
    return both[np.argsort(text[both], kind="stable")]


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(type S flags, LMS positions) of a text whose last unit is its least."""
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))  # ends of runs of one unit
    less = np.empty(len(change), bool)
    less[-1] = True
    less[:-1] = text[change[:-1]] < text[change[:-1] + 1]
    smaller = np.repeat(less, np.diff(np.append(-1, change)))
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _in_order(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """LMS positions in the order of their LMS substrings, for units below 256.

    Seven units at a time are compared as one number, with their types: of two that start with the same
    units, the one that ends first is larger, as its last unit is of type S and the other's of type L.
    """
    unit = text.astype(np.uint16) << np.uint16(1) | smaller
    size = np.diff(np.append(lms, len(text) - 1)) + 1
    order = np.arange(len(lms))
    rank = np.zeros(len(lms), np.int64)
    at, slot, done = np.arange(len(lms)), np.arange(len(lms)), 0
    while len(at):
        number = np.zeros(len(at), np.uint64)
        for k in range(done, done + 7):
            here = np.where(k < size[at], unit[np.minimum(lms[at] + k, len(text) - 1)], 0)
            number = number << np.uint64(9) | here.astype(np.uint64)
        by = np.lexsort((number, rank[at])) if done else np.argsort(number)
        at, number = at[by], number[by]
        order[slot] = at
        group = rank[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (group[1:] != group[:-1])
        rank[at] = slot[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        done += 7
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        go = tied & (size[at] > done)
        at, slot = at[go], slot[go]
    return lms[order]


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray, apart: int | None = None) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings by their order, equal for equal ones that do not start with ``apart``, in text order; and how many."""
    end = np.full(len(text), len(text))
    end[lms[:-1]] = lms[1:] + 1
    before, here = order[:-1], order[1:]
    size = end[here] - here
    same = size == end[before] - before
    if apart is not None:
        same &= text[here] != apart
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = text[before[live] + k] == text[here[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[size[live] > k]
    name = np.cumsum(np.append(True, ~same)) - 1
    names = np.zeros(len(text), np.int64)
    names[order] = name
    return names[lms], int(name[-1]) + 1


def suffix_array(text: np.ndarray, memory: int = MEMORY, folder: str | None = None, apart: int | None = None) -> np.ndarray:
    """Order of all suffixes of integer units; the last unit must be 0 and the only 0.

    With ``apart`` (the least unit after 0), suffixes that are equal up to that unit are in any order, so
    the recursion does not go on from one segment into the next.
    """
    if len(text) == 1:
        return np.zeros(1, np.int64)
    if text.max() < 1 << 16:
        text = text.astype(np.uint16)  # numpy sorts these by radix
    smaller, lms = _types(text)
    if len(lms) > 1:
        if text.max() < 256:
            order = _in_order(text, smaller, lms)
        else:
            order = _induce(text, smaller, lms, memory, folder)
            is_lms = np.zeros(len(text), bool)
            is_lms[lms] = True
            order = order[is_lms[order]]
        reduced, names = _names(text, lms, order, apart)
        lms = lms[suffix_array(reduced, memory, folder) if names < len(lms) else np.argsort(reduced)]
    return _induce(text, smaller, lms, memory, folder)


def common_prefixes(data: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Whether each suffix has its first ``most`` bytes in common with the one before it in ``at``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    packed = np.ndarray(len(data) + 1, np.uint64, padded.tobytes(), 0, (1,))
    same = np.zeros(len(at), bool)
    same[1:] = True
    for k in [*range(0, most - 7, 8), most - 8]:
        live = np.flatnonzero(same)
        same[live] = packed[at[live] + k] == packed[at[live - 1] + k]
    return same


def sorted_repeats(ids: np.ndarray, begin: np.ndarray, text: np.ndarray, length: int, memory: int = MEMORY, folder: str | None = None) -> np.ndarray:
    """A flag per byte: a window that starts here stands in a smaller document of the shard."""
    segments = len(begin) - 1
    owner = np.repeat(np.arange(segments), np.diff(begin))
    flags = np.zeros(len(text), bool)
    if not len(text):
        return flags
    # Units: 0 ends the shard, 1 ends a segment, bytes follow (UTF-8 has none above 0xF4).
    joined = np.full(len(text) + segments + 1, _BREAK, np.int64)
    joined[np.arange(len(text)) + owner] = text.astype(np.int64) + 2
    joined[-1] = _END
    order = suffix_array(joined, memory, folder, _BREAK)
    back = np.full(len(joined), -1)
    back[np.arange(len(text)) + owner] = np.arange(len(text))
    place = back[order]
    place = place[place >= 0]
    place = place[place + length <= begin[owner[place] + 1]]  # suffixes that are windows
    if not len(place):
        return flags
    fresh = np.flatnonzero(~common_prefixes(text, place, length))
    own = ids[owner[place]]
    least = np.minimum.reduceat(own, fresh)
    flags[place] = own > np.repeat(least, np.diff(np.append(fresh, len(place))))
    return flags


def _kept(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, runs, kept = [], [], [], []
        spans, copy = batch.column(3), batch.column(2)
        for lo, hi, data, offsets in common.text_blocks(batch, 1):
            for i in range(hi - lo):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                ranges = repeats.removed(spans[lo + i].as_py(), copy[lo + i].as_py(), len(text), length).tolist()
                total.append(len(text))
                gone.append(sum(b - a for a, b in ranges))
                runs.append(len(ranges))
                edges = [0, *(x for r in ranges for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            ["_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )
    common.give_back()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shape: repeats.Shape = BYTES, memory: int = MEMORY) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (the bytes left).

    A byte goes when a string of ``shape.length`` bytes covers it that also starts in a document with
    a smaller id. Null texts are empty. A null id comes after all others; rows with one id do not
    count as smaller than each other, so repeated rows keep their bytes. Strings may cut characters.
    """
    folder = common.mapped_folder(docs.sparkSession, "queues")
    method = functools.partial(sorted_repeats, memory=memory, folder=folder)
    _, rows = repeats.repeated_windows(docs, id_col, text, shape, method)
    done = rows.select("_id", "_text", "_copy", "spans").mapInArrow(
        lambda b: _kept(b, shape.length), "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
    return done.select(F.nullif("_id", F.lit(repeats.NULL_ID)).cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
