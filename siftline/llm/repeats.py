"""Where texts repeat: routing every window that may repeat to a task that sees all its equals.

Both substring operators look for windows of ``length`` units (bytes or words) that also start
in a document with a smaller id. A window's anchor is its least k-gram by hash, the leftmost of
equal ones; equal windows have equal anchors at equal places. Consecutive windows with one anchor
are a run. Runs meet by anchor in buckets, whose number follows the size of the text:

1. tasks send each run as a few hash bytes to its anchor's bucket, which answers whether the run
   as a whole stands in a smaller document, or whether other runs at the anchor may share windows
   with it (they agree on one of the stretches around the anchor that such windows have);
2. runs of the second kind are sent with their units, once for each distinct run, to the bucket,
   where the operator's own method (suffix sorting, or relative Lempel-Ziv parsing) finds the
   shared windows.

Anchors with many runs are counted beforehand. Their runs do not meet at the anchor. Runs that stand
as a whole in a smaller document are found by their hashes: tasks keep one entry per distinct run
and send the entries as arrays, dealt by hash. The others are split by what surrounds the anchor:
the windows that have one of the stretches go to the bucket of (anchor, stretch), four at most for a
run; equal windows have equal stretches, so they still meet, and the operator's method decides.
Stretches that many runs share, too, are the edge of one passage in many surroundings: their windows
find their smallest document by their hashes, by the same arrays, so no anchor gathers in one task.

Texts that are copies as a whole are settled beforehand by their digests.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import common

#: Text bytes whose runs a task holds before it sends them on.
FLUSH_BYTES = 8 << 20
#: Text bytes that are hashed at once.
BLOCK_BYTES = 1 << 19
#: A null id comes after all others.
NULL_ID = np.iinfo(np.int64).max
#: Stretches around an anchor that a run is asked by.
PROBES = 4
#: An anchor (or stretch) with more runs than this, and than 1/MOST_HOT of all runs, is hot; so there are fewer than MOST_HOT.
HOT = 2000
MOST_HOT = 100_000
#: In one task's FLUSH_BYTES, an anchor is not counted with a single run, nor with less than 1/MOST_HOT of the runs there (SEEN at most).
SEEN = 8
#: Bytes of distinct hashes that meet in one task.
CODE_BYTES = 32 << 20
_PLACE = np.uint64((1 << 27) - 1)


@dataclass(frozen=True)
class Shape:
    """What repeats: windows of ``length`` units, anchored by ``gram`` units; ``unit`` is byte or word."""

    unit: str
    length: int
    gram: int
    #: Text bytes per bucket: as many buckets as the text has of these.
    bucket_bytes: int = 4 << 20

    @property
    def cuts(self) -> list[tuple[int, int]]:
        """For windows with c to d - 1 units before the anchor: the units (before, behind) that all of them have."""
        extra = self.length - self.gram
        at = [(extra + 1) * j // PROBES for j in range(PROBES + 1)]
        return [(c, extra - d + 1) for c, d in zip(at[:-1], at[1:], strict=True)]


def units(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(values of all units of a block, where each document's units begin)."""
    if shape.unit == "byte":
        return data, offsets
    doc, _, _, code = common.words(data, offsets)
    return code, common.bounds_by_document(doc, len(offsets) - 1)


class Hashes:
    """Hashes of any range of units in constant time, from prefix sums."""

    def __init__(self, values: np.ndarray):
        value = common._BYTE[values] if values.dtype == np.uint8 else values
        n = len(value)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value * common.powers(common._BASE, n)[:n], out=self.sums[1:])
        self.back = common.powers(common._INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return common.mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return common.mix((self.sums[k:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


@dataclass
class Runs:
    """Runs of a block: document number, place of the anchor, first and last window."""

    doc: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hashes: Hashes
    gram: np.ndarray


def runs(values: np.ndarray, begin: np.ndarray, shape: Shape) -> Runs:
    hashes = Hashes(values)
    gram = hashes.grams(shape.gram)
    width = shape.length - shape.gram + 1
    none = np.zeros(0, np.int64)
    if len(values) < shape.length:
        return Runs(none, none, none, none, hashes, gram)
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & _PLACE).astype(np.int64)  # the anchor of the window that starts here
    whole = np.zeros(len(at) + 1, np.int32)
    size = np.diff(begin)
    long = np.flatnonzero(size >= shape.length)
    np.add.at(whole, begin[:-1][long], 1)
    np.add.at(whole, begin[:-1][long] + size[long] - shape.length + 1, -1)
    whole = np.cumsum(whole[:-1]) > 0
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    first = np.flatnonzero(change & whole)
    stop = np.ones(len(at), bool)
    stop[:-1] = change[1:] | ~whole[1:]
    last = np.flatnonzero(stop & whole)
    # Windows of two documents never share an anchor's run, even where one text ends as the next begins.
    doc = np.searchsorted(begin, first, "right") - 1
    return Runs(doc, at[first], first, last, hashes, gram)


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _numbers(gram: np.ndarray, n: np.ndarray, total: int) -> pa.RecordBatch:
    """Rows (gram, n), and one row (null, all of them)."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.append(gram.view(np.int64), 0), mask=np.append(np.zeros(len(gram), bool), True)), pa.array(np.append(n, total).astype(np.int64))], ["gram", "n"]
    )


def _counted(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """(_key, _id, _text) to (gram, n): anchors that have many runs within FLUSH_BYTES, and the number of all runs at null."""

    def told() -> pa.RecordBatch:
        all_ = np.concatenate(held)
        gram, n = np.unique(all_, return_counts=True)
        seen = n >= max(2, min(SEEN, len(all_) // MOST_HOT))
        return _numbers(gram[seen], n[seen], len(all_))

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for _, _, data, offsets in common.text_blocks(batch, 2, BLOCK_BYTES):
            r = runs(*units(data, offsets, shape), shape)
            held.append(r.gram[r.anchor])
            size += len(data)
            if size >= FLUSH_BYTES:
                yield told()
                held, size = [], 0
    if held:
        yield told()
    common.give_back()


def _often(counts: DataFrame, tag: str) -> np.ndarray:
    """The hot ones among counted (gram, n), sorted; fewer than MOST_HOT."""
    many = session.stage(counts.groupBy("gram").agg(F.sum("n").alias("n")).filter((F.col("n") > HOT) | F.col("gram").isNull()), tag)
    total = many.filter("gram IS NULL").first()
    limit = max(HOT, (total["n"] if total else 0) // MOST_HOT)
    found = many.filter(F.col("gram").isNotNull() & (F.col("n") > limit)).collect()
    return np.sort(np.array([x["gram"] for x in found], np.int64).view(np.uint64))


def _hot(gram: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which anchors are among the sorted hot ones."""
    return hot[np.minimum(np.searchsorted(hot, gram), len(hot) - 1)] == gram if len(hot) else np.zeros(len(gram), bool)


def _grouped(gram: np.ndarray, content: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by gram, content and id; whether another (gram, content) begins there)."""
    order = np.lexsort((ids, content, gram))
    g, c = gram[order], content[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    return order, fresh


def _flush(gram: np.ndarray, content: np.ndarray, keys: np.ndarray, ids: np.ndarray, place: np.ndarray) -> bytes:
    """Runs or windows of one task: their distinct (gram, content) with the smallest and largest ids, and each one's number among them."""
    order, fresh = _grouped(gram, content, ids)
    g, c, own = gram[order], content[order], ids[order]
    head = np.flatnonzero(fresh)
    code = np.empty(len(g), np.uint32)
    code[order] = np.cumsum(fresh) - 1
    return pickle.dumps((g[head], c[head], own[head], own[np.append(head, len(g))[1:] - 1], code, keys, ids, place.astype(np.uint32)), protocol=5)


def _hot_runs(batches: Iterator[pa.RecordBatch], shape: Shape, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(_key, _id, _text) to (blob): the runs of hot anchors."""

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_flush(*(np.concatenate(x) for x in zip(*held, strict=True)))], pa.binary())], ["blob"])

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False)
        for lo, _, data, offsets in common.text_blocks(batch, 2, BLOCK_BYTES):
            values, begin = units(data, offsets, shape)
            r = runs(values, begin, shape)
            gram = r.gram[r.anchor]
            at = np.flatnonzero(_hot(gram, hot))
            doc, content = r.doc[at], r.hashes.of(r.first[at], r.last[at] + shape.length)
            held.append((gram[at], content, keys[lo + doc], ids[lo + doc], r.first[at] - begin[doc]))
            size += len(data)
            if size >= FLUSH_BYTES:
                yield told()
                held, size = [], 0
    if held:
        yield told()
    common.give_back()


def _asked(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(blob, _flush) to (bucket, _flush, blob): the distinct codes of a flush, dealt by hash."""
    for batch in batches:
        rows: list[tuple[int, int, bytes]] = []
        for blob, flush in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            gram, content, low, high = pickle.loads(blob.as_py())[:4]
            which = _bucket(common.mix(gram ^ content), buckets)
            order = np.argsort(which, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], which[order][1:] != which[order][:-1]])) if len(order) else order
            for at in np.split(order, edge[1:]) if len(order) else []:
                rows.append((int(which[at[0]]), flush, pickle.dumps((gram[at], content[at], low[at], high[at], at.astype(np.uint32)), protocol=5)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.binary())], ["bucket", "_flush", "blob"]
        )
    common.give_back()


def _least(table: pa.Table) -> pa.Table:
    """One bucket of codes to (_flush, least): for each flush, the codes that a smaller document has, and that document."""
    parts = [pickle.loads(b) for b in table.column("blob").to_pylist()]
    gram, content, low, high = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order, fresh = _grouped(gram, content, low)
    least = np.empty_like(low)
    least[order] = low[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    edge = np.cumsum([0] + [len(p[0]) for p in parts])
    flushes, told = [], []
    for flush, p, a, b in zip(table.column("_flush").to_pylist(), parts, edge[:-1], edge[1:], strict=True):
        at = np.flatnonzero(least[a:b] < high[a:b])
        if len(at):
            flushes.append(flush)
            told.append(pickle.dumps((p[4][at], least[a:b][at]), protocol=5))
    common.give_back()
    return pa.table([pa.array(flushes, pa.int64()), pa.array(told, pa.binary())], names=["_flush", "least"])


def _smaller(blob: bytes, told: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a flush's runs or windows: key, place, and whether a smaller document has them."""
    _, _, low, _, code, keys, ids, place = pickle.loads(blob)
    least = low.copy()
    for x in told or []:
        at, value = pickle.loads(x)
        least[at] = value
    return keys, place.astype(np.int64), least[code] < ids


def _hot_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, least) of runs to (_key, marks)."""
    for batch in batches:
        for blob, told in zip(batch.column(0), batch.column(1), strict=True):
            keys, place, settled = _smaller(blob.as_py(), told.as_py())
            yield from _marks(keys, place, np.where(settled, 1, 2)).to_batches()
    common.give_back()


def _hot_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blob, least) of windows to (_key, blob)."""
    for batch in batches:
        for blob, told in zip(batch.column(0), batch.column(1), strict=True):
            keys, place, repeated = _smaller(blob.as_py(), told.as_py())
            yield from _spans(keys[repeated], place[repeated]).to_batches()
    common.give_back()


def _with_least(flushes: DataFrame, tag: str) -> DataFrame:
    """Blobs of ``_flush`` to (blob, least): what smaller documents have of it. Rows are whole flushes, not runs or windows."""
    held = session.stage(flushes.select("blob", F.monotonically_increasing_id().alias("_flush")), tag)
    buckets = common.parts(held.agg(F.sum(F.octet_length("blob"))).first()[0] or 0, CODE_BYTES)
    codes = held.mapInArrow(lambda b: _asked(b, buckets), "bucket int, _flush bigint, blob binary")
    least = codes.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_least, "_flush bigint, least binary")
    return held.join(least.groupBy("_flush").agg(F.collect_list("least").alias("least")), "_flush", "left").select("blob", "least")


@dataclass(frozen=True)
class Pieces:
    """Windows of runs that have one of the stretches around the anchor: their route, run, first window in the run, and number."""

    route: np.ndarray
    run: np.ndarray
    first: np.ndarray
    count: np.ndarray


def _pieces(gram: np.ndarray, anchor: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: Hashes, shape: Shape) -> Pieces:
    """The pieces of runs with the given anchors, which lie at ``begin`` to ``end`` of the hashed units."""
    extra = shape.length - shape.gram
    out = []
    for j, (before, behind) in enumerate(shape.cuts):
        first = np.maximum(begin, anchor - (extra - behind))
        last = np.minimum(end - shape.length, anchor - before)
        at = np.flatnonzero(first <= last)
        stretch = hashes.of(anchor[at] - before, anchor[at] + shape.gram + behind)
        out.append((common.mix(common.mix(gram[at] + np.uint64(j)) ^ stretch), at, first[at] - begin[at], last[at] - first[at] + 1))
    return Pieces(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _loaded(blob: bytes, shape: Shape) -> tuple[tuple[np.ndarray, ...], Hashes, Pieces]:
    gram, keys, ids, start, length, anchor, text = pickle.loads(blob)
    end = np.cumsum(length.astype(np.int64))
    begin = end - length
    hashes = Hashes(text)
    return (keys, ids, start.astype(np.int64), begin, text), hashes, _pieces(gram, begin + anchor, begin, end, hashes, shape)


def _routes(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """(blob) of hot runs to (gram, n): how many pieces have a route."""
    for batch in batches:
        for blob in batch.column(0):
            _, _, pieces = _loaded(blob.as_py(), shape)
            route, n = np.unique(pieces.route, return_counts=True)
            yield _numbers(route, n, len(pieces.route))
    common.give_back()


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after another."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _routed(batches: Iterator[pa.RecordBatch], shape: Shape, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(blob) of hot runs to pieces to compare (bucket, blob), and the windows of hot routes (bucket -2, blob as _flush)."""
    for batch in batches:
        for blob in batch.column(0):
            (keys, ids, start, begin, text), hashes, p = _loaded(blob.as_py(), shape)
            hot_ = _hot(p.route, hot)
            out: list[tuple[int, bytes]] = []
            if hot_.any():
                run, count = p.run[hot_], p.count[hot_]
                window = _spread(begin[run] + p.first[hot_], count)
                each = np.repeat(run, count)
                out.append((-2, _flush(np.repeat(p.route[hot_], count), hashes.of(window, window + shape.length), keys[each], ids[each], start[each] + window - begin[each])))
            at = np.flatnonzero(~hot_)
            run, length = p.run[at], p.count[at] + shape.length - 1
            out += _dealt(_bucket(p.route[at], buckets), keys[run], ids[run], start[run] + p.first[at], begin[run] + p.first[at], length, text, buckets)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "blob"])
    common.give_back()


def _dealt(which: np.ndarray, keys: np.ndarray, ids: np.ndarray, start: np.ndarray, place: np.ndarray, length: np.ndarray, text: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, blob) of segments that lie at ``place`` of the text."""
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[b] : edges[b + 1]]
        out.append((b, pickle.dumps((keys[at], ids[at], start[at].astype(np.uint32), length[at].astype(np.uint32), text[_spread(place[at], length[at])]), protocol=5)))
    return out


def _entries(batches: Iterator[pa.RecordBatch], shape: Shape, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(_key, _id, _text) to (bucket, blob): the hashes of all runs but those of hot anchors, in document order within a blob."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False)
        for lo, _, data, offsets in common.text_blocks(batch, 2, BLOCK_BYTES):
            values, begin = units(data, offsets, shape)
            r = runs(values, begin, shape)
            after = r.anchor + shape.gram
            probes = np.zeros((len(r.doc), PROBES), np.uint8)
            for j, (before, behind) in enumerate(shape.cuts):
                ok = (r.anchor - before >= r.first) & (after + behind <= r.last + shape.length)
                code = r.hashes.of(np.maximum(r.anchor - before, 0), np.minimum(after + behind, len(values)))
                probes[:, j] = np.where(ok, code % np.uint64(255) + np.uint64(1), 0)
            gram = r.gram[r.anchor]
            entry = (_bucket(gram, buckets), gram.astype(np.uint32), r.hashes.of(r.first, r.last + shape.length), probes, keys[lo + r.doc], ids[lo + r.doc], (r.first - begin[r.doc]).astype(np.uint32))
            cold = ~_hot(gram, hot)
            held.append(entry if cold.all() else tuple(x[cold] for x in entry))
            size += len(data)
            if size >= FLUSH_BYTES:
                yield _sent(held, buckets)
                held, size = [], 0
    if held:
        yield _sent(held, buckets)
    held = []
    common.give_back()


def _sent(held: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    which, gram, content, probes, keys, ids, first = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(buckets + 1))
    rows, blobs = [], []
    for b in range(buckets):
        at = order[ends[b] : ends[b + 1]]
        if len(at):
            own = keys[at]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            runs_ = np.diff(np.append(start, len(own))).astype(np.uint32)
            code = content[at]
            rows.append(b)
            blobs.append(pickle.dumps((gram[at], code.astype(np.uint32), (code >> np.uint64(48)).astype(np.uint16), probes[at], own[start], ids[at][start], runs_, first[at]), protocol=5))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _verdicts(gram: np.ndarray, content: np.ndarray, probes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each run: 1 it stands as a whole in a smaller document, 2 it may share windows with other runs, else 0."""
    order, fresh = _grouped(gram, content, ids)
    group = np.cumsum(fresh) - 1
    heads = order[fresh]
    out = np.zeros(len(order), np.uint8)
    out[order] = (ids[order] > ids[heads][group]).astype(np.uint8)
    need = np.zeros(len(heads), bool)
    for side in probes[heads].T:  # 8 bits of the hash of a stretch; 0 where the run has no window with it
        key = gram[heads].astype(np.uint64) << np.uint64(8) | side
        by = np.argsort(key, kind="stable")
        same = np.zeros(len(key), bool)
        same[1:] = key[by][1:] == key[by][:-1]
        same[:-1] |= same[1:]
        need[by] |= same & (side[by] != 0)
    asked = np.zeros(len(order), bool)
    asked[order] = need[group]
    out[asked & (out == 0)] = 2
    return out


def _answers(table: pa.Table) -> pa.Table:
    """One bucket of runs to (_key, marks): places and verdicts of the runs that have one."""
    parts = [pickle.loads(b) for b in table.column("blob").to_pylist()]
    gram, low, high, probes, first = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 7))
    keys, ids = (np.concatenate([np.repeat(p[i], p[6]) for p in parts]) for i in (4, 5))
    verdict = _verdicts(gram, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), probes, ids)
    told = np.flatnonzero(verdict)
    marks = _marks(keys[told], first[told], verdict[told])
    common.give_back()
    return marks


def _marks(keys: np.ndarray, first: np.ndarray, verdict: np.ndarray) -> pa.Table:
    """(_key, marks): the places and verdicts of each key's runs."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    code = first[order].astype(np.uint32) << np.uint32(1) | (verdict[order] - 1).astype(np.uint32)
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    ends = (np.append(start, len(own)) * 4).astype(np.int32)
    marks = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(code.tobytes())])
    return pa.table([pa.array(own[start], pa.int64()), marks], names=["_key", "marks"])


def _details(batches: Iterator[pa.RecordBatch], shape: Shape, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(_key, _id, _text, marks) to rows of settled windows (bucket -1, key, spans), of runs to compare (bucket, blob), and hot ones (bucket -2, blob)."""
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False)
        marks = batch.column(3)
        out: list[tuple[int, int, bytes]] = []
        sent: list[tuple] = []
        for lo, hi, data, offsets in common.text_blocks(batch, 2, BLOCK_BYTES):
            values, begin = units(data, offsets, shape)
            r = runs(values, begin, shape)
            code = np.zeros(len(r.doc), np.uint8)
            start = r.first - begin[r.doc]
            edge = np.searchsorted(r.doc, np.arange(hi - lo + 1))
            for i in range(hi - lo):
                said = np.concatenate([np.frombuffer(m, np.uint32) for m in marks[lo + i].as_py()])
                at = edge[i] + np.searchsorted(start[edge[i] : edge[i + 1]], said >> np.uint32(1))
                code[at] = (said & np.uint32(1)) + 1
                done = at[code[at] == 1]
                if len(done):
                    spans = np.stack([start[done], r.last[done] - begin[r.doc[done]]], 1)
                    out.append((-1, int(keys[lo + i]), joined(spans).astype(np.uint32).tobytes()))
            asked = np.flatnonzero(code == 2)
            split = _hot(r.gram[r.anchor[asked]], hot)
            if split.any():
                at, asked = asked[split], asked[~split]
                length = r.last[at] + shape.length - r.first[at]
                text = values[_spread(r.first[at], length)]
                own = lo + r.doc[at]
                out.append((-2, 0, pickle.dumps((r.gram[r.anchor[at]], keys[own], ids[own], start[at].astype(np.uint32), length, r.anchor[at] - r.first[at], text), protocol=5)))
            if len(asked):
                gram = r.gram[r.anchor[asked]]
                length = r.last[asked] + shape.length - r.first[asked]
                text = values[_spread(r.first[asked], length)]
                sent.append((_bucket(gram, buckets), keys[lo + r.doc[asked]], ids[lo + r.doc[asked]], start[asked], length, text))
        if sent:
            which, key, own, start, length = (np.concatenate([x[i] for x in sent]) for i in range(5))
            text = np.concatenate([x[5] for x in sent])
            out += [(b, 0, blob) for b, blob in _dealt(which, key, own, start, np.cumsum(length) - length, length, text, buckets)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "_key", "blob"]
        )
    common.give_back()


def joined(spans: np.ndarray) -> np.ndarray:
    """Disjoint, sorted ranges (first, last inclusive) that cover the same windows; neighbours are joined."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), bool)
    fresh[1:] = spans[1:, 0] > reach[:-1] + 1
    at = np.flatnonzero(fresh)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], 1)


#: (ids, starts of the segments, their units) to a flag per unit: does a window that starts here stand in a smaller document?
Method = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def _compared(table: pa.Table, shape: Shape, method: Method) -> pa.Table:
    parts = [pickle.loads(b) for b in table.column("blob").to_pylist()]
    keys, ids, start, length = (np.concatenate([p[i] for p in parts]) for i in range(4))
    text = np.concatenate([p[4] for p in parts])
    begin = np.concatenate([[0], np.cumsum(length.astype(np.int64))])
    flags = method(ids, begin, text, shape.length)
    at = np.flatnonzero(flags)
    segment = np.searchsorted(begin, at, "right") - 1
    own, place = keys[segment], start[segment].astype(np.int64) + at - begin[segment]
    spans = _spans(own, place)
    del parts, text, flags
    common.give_back()
    return spans


def _spans(own: np.ndarray, place: np.ndarray) -> pa.Table:
    """(_key, blob): ranges of each key's windows."""
    order = np.lexsort((place, own))
    own, place = own[order], place[order]
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    blobs = []
    for a, b in zip(edge, np.append(edge, len(own))[1:], strict=True):
        blobs.append(joined(np.stack([place[a:b], place[a:b]], 1)).astype(np.uint32).tobytes())
    return pa.table([pa.array(own[edge], pa.int64()), pa.array(blobs, pa.binary())], names=["_key", "blob"])


def repeated_windows(docs: DataFrame, id_col: str, text: str, shape: Shape, method: Method) -> tuple[DataFrame, DataFrame]:
    """(staged ``_key``, ``spans``: ranges of windows that stand in smaller documents; rows to apply them to).

    The rows are ``_key``, ``_id`` (null as NULL_ID), ``_text``, and ``_copy``, true where the whole
    text stands in a smaller document. Marks and spans belong to the ``_key``, a hash of id and text:
    an id, null above all, may stand on several texts, and tells only which document is smaller.
    """
    common.ship(docs.sparkSession)
    plain = docs.select(
        F.coalesce(common.named(id_col).cast("long"), F.lit(NULL_ID)).alias("_id"), common.text_of(text).alias("_text"),
        F.unhex(F.sha2(common.text_of(text), 256)).alias("_sha"),
    ).withColumn("_key", F.xxhash64("_id", "_sha"))
    keys = session.stage(plain.select("_id", "_sha", F.octet_length("_text").alias("size")), "digests")
    copies = session.stage(keys.groupBy("_sha").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")).filter("_n > 1"), "copied")
    rows = common.attach(plain, copies, "_sha", ["_least", "_n"], weight="_n").select(
        "_key", "_id", "_text", F.coalesce(F.col("_id") > F.col("_least"), F.lit(False)).alias("_copy")
    )
    buckets = common.parts(keys.agg(F.sum("size")).first()[0] or 0, shape.bucket_bytes)
    own = rows.filter("NOT _copy").select("_key", "_id", "_text")
    hot = _often(own.mapInArrow(lambda b: _counted(b, shape), "gram bigint, n bigint"), "often")
    entries = own.mapInArrow(lambda b: _entries(b, shape, buckets, hot), "bucket int, blob binary")
    answers = entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answers, "_key bigint, marks binary")
    if len(hot):
        told = _with_least(own.mapInArrow(lambda b: _hot_runs(b, shape, hot), "blob binary"), "hot-runs")
        answers = answers.unionByName(told.mapInArrow(_hot_marks, "_key bigint, marks binary"))
    marks = session.stage(answers.groupBy("_key").agg(F.collect_list("marks").alias("marks")), "marks")
    size = marks.agg(F.sum(F.aggregate("marks", F.lit(0), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    # Marks of bytes are a good part of the text itself: they join by shuffle at every size.
    small = shape.unit == "word" and size <= session.BROADCAST_BYTES
    asked = own.join(F.broadcast(marks) if small else marks, "_key")
    details = session.stage(asked.mapInArrow(lambda b: _details(b, shape, buckets, hot), "bucket int, _key bigint, blob binary"), "details")
    apart = details.filter("bucket >= 0").select("bucket", "blob")
    settled = details.filter("bucket = -1").select("_key", "blob")
    if len(hot):
        split = details.filter("bucket = -2").select("blob")
        routes = _often(split.mapInArrow(lambda b: _routes(b, shape), "gram bigint, n bigint"), "routes")
        routed = session.stage(split.mapInArrow(lambda b: _routed(b, shape, buckets, routes), "bucket int, blob binary"), "routed")
        apart = apart.unionByName(routed.filter("bucket >= 0"))
        if len(routes):
            told = _with_least(routed.filter("bucket = -2").select("blob"), "hot-windows")
            settled = settled.unionByName(told.mapInArrow(_hot_spans, "_key bigint, blob binary"))
    compared = apart.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _compared(t, shape, method), "_key bigint, blob binary")
    settled = settled.unionByName(compared)
    spans = session.stage(settled.groupBy("_key").agg(F.collect_list("blob").alias("spans")), "spans")
    size = spans.agg(F.sum(F.aggregate("spans", F.lit(0), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    return spans, rows.join(F.broadcast(spans) if size <= session.BROADCAST_BYTES else spans, "_key", "left")


def removed(spans: list[bytes] | None, copy: bool, n: int, length: int) -> np.ndarray:
    """(first, end) of the maximal ranges of units that repeated windows cover in a text of ``n`` units."""
    if copy:
        return np.array([[0, n]]) if n >= length else np.zeros((0, 2), np.int64)
    if not spans:
        return np.zeros((0, 2), np.int64)
    pairs = np.concatenate([np.frombuffer(s, np.uint32).astype(np.int64).reshape(-1, 2) for s in spans])
    pairs[:, 1] += length - 1
    out = joined(pairs)
    out[:, 1] += 1
    return out
