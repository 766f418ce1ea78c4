"""Hard negatives of anchors, by exact integer products of packed vectors.

Vectors are floored to integers. The components of several candidates are made positive by a bias
and put into separate fields of one wide integer; one product with an anchor's (biased) component
multiplies them all, and the fields of the sum over components are the exact scores, less what the
biases added. Integers of up to 53 bits are held in doubles, so that a matrix product does it; where
a field needs more, integers of any width do. Anchors and candidates meet as blocks, each pair of
blocks once: first for the best candidates of the same label, then for those of other labels. A task
holds a group of candidate blocks and reads the anchors past it; neither side is ever broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import common

SCALE = 256
#: Candidates and anchors of a block.
CANDIDATES, ANCHORS = 4096, 512
#: Bytes of candidates that a task holds while the anchors pass.
GROUP_BYTES = 64 << 20
#: Anchors of a product: its entries stay in the processor's cache.
TILE = 64
#: Candidates that share a wide integer, where fields do not fit in a double.
WIDE_FIELDS = 16
#: An id that is null comes last among ties.
LAST = np.iinfo(np.int64).max
_BLOCK = "block long, dim int, rows array<long>, ids array<long>, labels array<int>, parts array<double>, goals array<array<long>>, goal_ids array<array<long>>"


# --- packed products ------------------------------------------------------------------------


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered vectors (rows of two arrays of doubles).

    An int64 array where every field fits in a double, else an array of Python integers.
    """
    a, c = _widened(anchors, candidates)
    n, dim = c.shape
    if not n or not len(a) or not dim:
        return np.zeros((len(a), n), np.int64)
    low_a, low_c = min(0, int(a.min())), min(0, int(c.min()))
    high_a, high_c = int(a.max()) - low_a, int(c.max()) - low_c
    width = max(1, (dim * high_a * high_c).bit_length())
    wide = width > 53 or dim * max(-low_a, high_a + low_a) * max(-low_c, high_c + low_c) >= 1 << 55
    fields = WIDE_FIELDS if wide else 53 // width
    kind = object if wide else np.float64

    def whole(x: np.ndarray, low: int) -> np.ndarray:
        return np.array([[int(v) - low for v in row] for row in x], object).reshape(x.shape) if wide else x - low

    bias_a, bias_c = whole(a, low_a), whole(c, low_c)
    # Field k holds the k-th stretch of the candidates.
    each = -(-n // fields)
    packed = np.zeros((each, dim), kind)
    for k in range(fields):
        part = bias_c[k * each : (k + 1) * each]
        packed[: len(part)] += part * ((1 << width * k) if wide else float(1 << width * k))
    # (a - low_a)(c - low_c) = ac - low_c a - low_a c + low_a low_c
    back = bias_a.sum(1) * low_c + dim * low_a * low_c
    other = bias_c.sum(1) * low_a
    if not wide:
        back, other = back.astype(np.int64), other.astype(np.int64)
    mask = (1 << width) - 1
    out = np.empty((len(a), n), object if wide else np.int64)
    for i in range(0, len(a), TILE):
        product = bias_a[i : i + TILE] @ packed.T
        if not wide:
            product = product.astype(np.int64)
        for k in range(fields):
            field = out[i : i + TILE, k * each : (k + 1) * each]
            field[:] = (product >> (width * k) & mask)[:, : field.shape[1]]
        out[i : i + TILE] += back[i : i + TILE, None] + other
    return out


def _widened(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many components: those that a vector lacks are 0."""
    dim = max(a.shape[1], c.shape[1])
    return (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a, c))


def best(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``n`` entries of each row: highest first, of equal ones the leftmost."""
    if values.dtype == object or values.shape[1] <= n:
        picked = [sorted(range(values.shape[1]), key=lambda j, row=row: (-row[j], j))[:n] for row in values]
        rows = np.repeat(np.arange(len(values)), [len(p) for p in picked])
        return rows, np.array([j for p in picked for j in p], np.int64)
    # All that reach the n-th highest value of their row, then the n first of them.
    least = np.partition(values, values.shape[1] - n, axis=1)[:, -n]
    return _first(values, *np.nonzero(values >= least[:, None]), n)


def _order(row: np.ndarray, score: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The order of entries by row, the highest score, and the least ``tie``."""
    if score.dtype == object:
        return np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], tie[i])), np.int64)
    return np.lexsort((tie, -score, row))


def _first(values: np.ndarray, row: np.ndarray, column: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of entries listed row by row, the first ``n`` of each row."""
    order = _order(row, values[row, column], column)
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[keep], column[keep]


class _Running:
    """The first ``n`` entries of each of ``size`` keys, of all blocks seen so far: highest score first, then the least id."""

    def __init__(self, size: int, n: int):
        self.n = n
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: The lowest score that a key holds; where ``open``, it holds fewer than ``n``, and any score enters.
        self.least, self.open = np.zeros(size, np.int64), np.ones(size, bool)

    def reach(self, key: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Which of the entries are not behind the first ``n`` of their key."""
        return self.open[key] | (score >= self.least[key])

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids)))
        order = _order(key, score, ids)
        order = order[np.arange(len(order)) - np.searchsorted(key[order], key[order]) < self.n]
        self.key, self.score, self.id = key[order], score[order], ids[order]
        self.open = np.bincount(self.key, minlength=len(self.open)) < self.n
        self.least = self.least.astype(score.dtype)
        self.least[self.key] = self.score  # the last of a key is its lowest


# --- blocks -----------------------------------------------------------------------------------


def _vectors(table: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(row, vec_id, label, vector) of the rows that take part; ``row`` is their own number."""
    x = common.named(vector).cast("array<double>")
    # The greatest is NaN if any is; both ends are null where there are no components.
    ends = [F.coalesce(end(x), F.lit(0.0)) for end in (F.array_min, F.array_max)]
    finite = (F.size(F.array_compact(x)) == F.size(x)) & ~F.isnan(ends[1]) & (ends[0] * SCALE != float("-inf")) & (ends[1] * SCALE != float("inf"))
    vid, lab = common.named(vec_id).cast("long"), common.named(label).cast("int")
    moved = F.when(F.coalesce(vid % 7 == 0, F.lit(False)), F.pmod(lab + 1, F.lit(10))).otherwise(lab)
    valid = table.filter(lab.isNotNull() & x.isNotNull() & finite)
    # Beyond 2^53 every double is whole, and a floor in 64 bits could not hold it.
    whole = F.transform(x, lambda v: F.when(F.abs(v) < float(1 << 53) / SCALE, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE))
    slim = valid.select(vid.alias("vec_id"), moved.alias("label"), whole.alias("vector"))
    return session.stage(slim.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _packed_blocks(rows: DataFrame, each: int, count: int) -> DataFrame:
    """Blocks of about ``each`` rows, one row per block, its vectors ordered by (id, row)."""
    blocks = common.parts(count, each)
    goals = [c for c in ("goals", "goal_ids") if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("array<long>") for c in goals})
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return session.stage(dealt.groupBy("block").applyInArrow(_pack, _BLOCK), "blocks")


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    ids = pc.fill_null(table.column("vec_id"), LAST).to_numpy()
    order = pa.array(np.lexsort((table.column("row").to_numpy(), ids)))
    table = table.take(order).combine_chunks()
    vectors = table.column("vector").combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    dim = int(sizes.max(initial=0))
    dense = np.zeros((len(sizes), dim))
    dense[np.arange(dim) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)

    def one(values, kind: pa.DataType) -> pa.Array:
        return pa.array([values], kind)

    return pa.Table.from_arrays(
        [
            pa.array([key[0].as_py()], pa.int64()), pa.array([dim], pa.int32()),
            one(table.column("row").to_numpy(), pa.list_(pa.int64())), one(ids[order.to_numpy()], pa.list_(pa.int64())),
            one(table.column("label").to_numpy(), pa.list_(pa.int32())), one(dense.ravel(), pa.list_(pa.float64())),
            one(table.column("goals").to_pylist(), pa.list_(pa.list_(pa.int64()))), one(table.column("goal_ids").to_pylist(), pa.list_(pa.list_(pa.int64()))),
        ],
        ["block", "dim", "rows", "ids", "labels", "parts", "goals", "goal_ids"],
    )


class _Block:
    """The vectors of a block as arrays."""

    def __init__(self, row: dict):
        self.rows, self.ids = (np.asarray(row[k], np.int64) for k in ("rows", "ids"))
        self.labels = np.asarray(row["labels"], np.int32)
        self.parts = np.asarray(row["parts"], float).reshape(len(self.rows), row["dim"])
        self.goals, self.goal_ids = row["goals"], row["goal_ids"]


def _groups(count: int, anchors: int, dim: int, blocks: int, cores: int) -> int:
    """How many groups the blocks of candidates are dealt into; every group gets all anchors.

    Enough for a group to fit in a task. More, for all cores, only while the anchors sent take no more than the candidates.
    """
    spread = min(2 * cores, count // max(anchors, 1))
    return max(1, min(blocks, max(common.parts(8 * count * dim, GROUP_BYTES), spread)))


def _meet(anchors: DataFrame, candidates: DataFrame, groups: int, found, schema: str) -> DataFrame:
    """``found(anchors, blocks of candidates)`` of every block of anchors and every group of candidates.

    Both sides are dealt by shuffle: a join would broadcast the anchors by the size of their files, and the driver
    would gather a copy for each group. A task holds its candidates, and one block of anchors after the other.
    """
    names = ["dim", "rows", "ids", "labels", "parts", "goals", "goal_ids"]
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = anchors.select(every.alias("to"), F.lit(1).alias("side"), *names)
    right = candidates.select(F.pmod("block", F.lit(groups)).cast("int").alias("to"), F.lit(0).alias("side"), *names)
    dealt = right.unionByName(left).repartitionById(groups, "to").sortWithinPartitions("to", "side")
    kind = pa.schema([pa.field(*_arrow(f)) for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for i in range(len(batch)):
                row = {k: v.values if isinstance(v, pa.ListScalar) and k not in ("goals", "goal_ids") else v.as_py() for k, v in zip(batch.schema.names, (c[i] for c in batch.columns), strict=True)}
                if row["to"] != at:
                    at, held = row["to"], []
                if row["side"] == 0:
                    held.append(_Block(row))
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found(_Block(row), held), kind, strict=True)], schema=kind)
        common.give_back()

    return dealt.mapInArrow(run, schema)


def _arrow(field: str) -> tuple[str, pa.DataType]:
    name, kind = field.split(" ")
    return name, {"long": pa.int64(), "int": pa.int32()}[kind]


_FOUND = "row long, anchor_id long, id long, score long"


def _same_label(n: int):
    def found(a: _Block, held: list[_Block]) -> list:
        """The best ``n`` candidates of the same label of each anchor, itself left out."""
        kept = _Running(len(a.rows), n)
        for c in held:
            seen = []
            for label in np.intersect1d(a.labels, c.labels).tolist():
                mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(c.labels == label)
                s = scores(a.parts[mine], c.parts[theirs])
                if kept.open[mine].any():
                    row, column = best(s, n + 1)
                else:
                    row, column = np.nonzero(s >= kept.least[mine, None])
                other = a.rows[mine[row]] != c.rows[theirs[column]]
                row, column = row[other], column[other]
                seen.append((mine[row], s[row, column], c.ids[theirs[column]]))
            if seen:
                kept.add(*(np.concatenate(x) for x in zip(*seen, strict=True)))
        return [a.rows[kept.key], a.ids[kept.key], kept.id, kept.score]

    return found


_WANTED = "row long, goal int, anchor_id long, positive_id long, positive_score long, id long, score long"


def _other_label(n: int, low: int, high: int):
    def found(a: _Block, held: list[_Block]) -> list:
        """The best ``n`` candidates of other labels in the window below each positive's score."""
        # The wanted: (anchor, number of its positive, score, id), anchor by anchor.
        of = np.repeat(np.arange(len(a.rows)), [len(g) for g in a.goals])
        start = np.searchsorted(of, np.arange(len(a.rows)))
        goal = np.array([x for g in a.goals for x in g], object)
        positive = np.array([x for g in a.goal_ids for x in g], np.int64)
        lowest, highest = -(-low * goal // 100), high * goal // 100
        kept = _Running(len(of), n)
        for c in held:
            s = scores(a.parts, c.parts)
            # Scores in 64 bits are far within these limits.
            down, up = (lowest, highest) if s.dtype == object else (np.clip(x, -(1 << 62), 1 << 62).astype(np.int64) for x in (lowest, highest))
            enough = np.where(kept.open, down, np.maximum(down, kept.least))
            near = (s >= np.minimum.reduceat(enough, start)[:, None]) & (s <= np.maximum.reduceat(up, start)[:, None])
            near &= c.labels != a.labels[:, None]
            row, column = np.nonzero(near)
            score, ids = s[row, column], c.ids[column]
            for k in range(max((len(g) for g in a.goals), default=0)):
                key = start[row] + k
                has = np.flatnonzero(key < np.append(start[1:], len(of))[row])
                has = has[(score[has] >= down[key[has]]) & (score[has] <= up[key[has]]) & kept.reach(key[has], score[has])]
                kept.add(key[has], score[has], ids[has])
        key = kept.key
        return [a.rows[of[key]], key - start[of[key]], a.ids[of[key]], positive[key], goal[key], kept.id, kept.score]

    return found


def _ranked(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _shown(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(int(LAST)))


def mine(
    table: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Hard negatives of every anchor and positive: (anchor_id, positive_id, rank, negative_id, two scores).

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its first other
    rows of the same label, and the negatives of a positive its first rows of another label with
    ``low * positive <= 100 * negative <= high * positive``. Higher scores come first, ties by the smaller id.

    Rows with a null label or vector, or a component that is null, not finite, or beyond a double when
    scaled, take no part. A row without id is no anchor and comes last among ties; a repeated row is
    another row, as anchor, positive and negative. Of vectors of different lengths the shorter is filled
    up with zeros. No anchors, no rows or no vectors with components give an empty result or scores of 0.
    A returned score beyond 64 bits fails the job. Other columns play no part. Runs jobs when called.
    """
    common.ship(table.sparkSession)
    rows = _vectors(table, vec_id, vector, label)
    anchor = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    count, anchors, dim = rows.agg(F.count("*"), F.count_if(anchor), F.max(F.size("vector"))).first()
    groups = _groups(count, anchors, dim or 0, common.parts(count, CANDIDATES), table.sparkSession.sparkContext.defaultParallelism)
    candidates = _packed_blocks(rows, CANDIDATES, count)
    asking = rows.filter(anchor)
    near = _meet(_packed_blocks(asking, ANCHORS, anchors), candidates, groups, _same_label(positives), _FOUND)
    near = _ranked(near, ["row"], positives)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    goals = near.groupBy("row").agg(ordered.alias("g")).select("row", F.col("g.score").alias("goals"), F.col("g.id").alias("goal_ids"))
    goals = session.stage(asking.join(goals, "row"), "goals")
    far = _meet(_packed_blocks(goals, ANCHORS, anchors), candidates, groups, _other_label(negatives, low, high), _WANTED)
    far = _ranked(far, ["row", "goal"], negatives)
    return far.select(
        "anchor_id", _shown("positive_id").alias("positive_id"), "rank",
        _shown("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
