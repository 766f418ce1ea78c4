"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is a weighted set: word 5-grams with their number of occurrences. A unit of weight
of an element is a region of its own (the k-th occurrence is the cell ``hash(gram, k)``), and
darts fall on each region as a Poisson process along the rank axis, seeded by the cell. The
darts below a rank are hashed to coordinates, and each coordinate keeps its earliest dart; two
documents agree in a coordinate with the chance of their weighted Jaccard similarity.

Candidates share a band of coordinates. Each member of a band's bucket is compared with one centre
of the bucket, on the exact weighted sets, and links make classes. Only buckets that still hold
several classes are compared further, and only across them: pair by pair where these are few, else
in blocks of members inside tasks, which return links and never pairs. No candidate is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import common

SHINGLE = 5
BANDS, ROWS = 24, 5
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def cells(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, cell) of all unit regions of a block, sorted by document, and each document's digest.

    A text of fewer than ``shingle`` words, but at least one, is one gram of all its words; a text
    without words has no region. The digest is of the word sequence.
    """
    n = len(offsets) - 1
    doc, _, _, code = common.words(data, offsets)
    first = common.bounds_by_document(doc, n)
    count = np.diff(first)
    place = np.arange(len(doc)) - first[doc]
    gram = code.copy()
    for k in range(1, shingle):
        nxt = np.roll(code, -k)
        gram = np.where(place + k < count[doc], common.mix(gram ^ nxt * _GRAM), gram)
    whole = place + shingle <= count[doc]
    keep = whole | ((place == 0) & (count[doc] > 0))
    doc, gram = doc[keep], gram[keep]
    # The k-th occurrence of a gram in its document is cell k.
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    run = np.arange(len(doc)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(doc) else np.zeros(0, np.int64)
    return doc, common.mix(gram + run.astype(np.uint64) * _GRAM), first


def darts(doc: np.ndarray, cell: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures (n documents x ``size`` coordinates) from unit regions sorted by document.

    Darts of a region have ranks that are sums of exponential
    steps, so regions and darts are the same in whichever document the cell occurs.
    """
    weight = np.bincount(doc, minlength=n)
    best = np.full(n * size, np.inf)
    open_ = np.flatnonzero(weight)
    hi = np.zeros(n)
    hi[open_] = size * (math.log(size) + 2) / weight[open_]
    live = np.arange(len(doc))
    rank, number = np.zeros(len(doc)), np.zeros(len(doc), np.uint64)
    while len(open_):
        # Throw the darts below rank hi that were not thrown before, for documents that lack a coordinate.
        going = live
        while len(going):
            step = common.mix(cell[going] + (number[going] + np.uint64(1)) * common._MIX)
            at = rank[going] - np.log((step >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            hit = at < hi[doc[going]]
            going, at, step = going[hit], at[hit], step[hit]
            rank[going] = at
            number[going] += np.uint64(1)
            slot = doc[going] * size + (common.mix(step ^ _GRAM) % np.uint64(size)).astype(np.int64)
            np.minimum.at(best, slot, at)
        open_ = open_[np.isinf(best.reshape(n, size)[open_]).any(axis=1)]
        hi[open_] *= 2
        live = live[np.isin(doc[live], open_)]
    # The rank of a dart names it: equal ranks are the same dart of the same cell.
    best[np.isinf(best)] = 0
    return common.mix(best.view(np.uint64)).reshape(n, size)


def bands(signature: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band (documents x bands)."""
    out = np.zeros((len(signature), n_bands), np.uint64)
    for b in range(n_bands):
        key = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            key = common.mix(key ^ signature[:, b * rows + r])
        out[:, b] = key
    return out


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128 bits of each document's sequence of words."""
    doc, _, _, code = common.words(data, offsets)
    first = common.bounds_by_document(doc, len(offsets) - 1)
    place = (np.arange(len(doc)) - first[doc]).astype(np.uint64)
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for i in range(2):
        sums = np.zeros(len(doc) + 1, np.uint64)
        np.cumsum(common.mix(code ^ common.mix(place * np.uint64(2) + np.uint64(i))), out=sums[1:])
        out[:, i] = sums[first[1:]] - sums[first[:-1]]
    return [row.tobytes() for row in out]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, text) to (_id, _node, _bands); a text without words has no bands."""
    for batch in batches:
        for lo, hi, data, offsets in common.text_blocks(batch, 1, 1 << 19):
            n = hi - lo
            doc, cell, _ = cells(data, offsets)
            has = np.bincount(doc, minlength=n) > 0
            keys = bands(darts(doc, cell, n, BANDS * ROWS))[has].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(has) * BANDS]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(_digests(data, offsets), pa.binary()), lists], ["_id", "_node", "_bands"])
    common.give_back()


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_key, text) to (_node, _cells)."""
    for batch in batches:
        for lo, hi, data, offsets in common.text_blocks(batch, 1):
            doc, cell, _ = cells(data, offsets)
            ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_digests(data, offsets), pa.binary()), lists], ["_node", "_cells"])
    common.give_back()


#: A bucket whose pairs across classes are at most this many per member is compared pair by pair;
#: a larger one by blocks of members inside tasks, which give links but no pairs.
PAIRS_PER_ROW = 4
BLOCK = 512


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) for every node of ``edges`` (``a``, ``b``): the least node that it reaches.

    Alternates large-star and small-star steps, each a map-side combined minimum and a join,
    staged, until no edge changes.
    """
    edges = session.stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = session.stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def _verified(pairs: DataFrame, regions: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose exact weighted Jaccard similarity reaches the threshold.

    Joins are left to Spark, which splits the partition of a centre with many members.
    """
    side = lambda x: regions.select(F.col("_node").alias(x), F.col("_cells").alias(f"c{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common_ = F.size(F.array_intersect("ca", "cb"))
    return both.filter(common_ >= similarity * (F.size("ca") + F.size("cb") - common_)).select("a", "b")


def _few_pairs(few: DataFrame) -> DataFrame:
    """Pairs across the classes of a bucket: members outside its main class (``main``) with all members.

    No class is larger than the main one, so the join walks at most twice the pairs across classes;
    the main class is never joined with itself.
    """
    x = few.filter("label <> main").select("key", F.col("node").alias("x"), F.col("label").alias("lx"))
    y = few.select("key", F.col("node").alias("y"), F.col("label").alias("ly"))
    across = x.join(y, "key").filter("lx <> ly")
    return across.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _block_links(table: pa.Table, similarity: float) -> pa.Table:
    """Links between the classes of one block of a bucket: enough of them to join what is joined.

    Exact: the intersections of all pairs are products of 0/1 matrices, over slices of the cells.
    A member that has too few of its cells in the whole block cannot be linked and is left out.
    """
    table = table.combine_chunks()
    side = table.column("side").to_numpy()
    node, label = np.array(table.column("node").to_pylist(), object), np.array(table.column("label").to_pylist(), object)
    lists = [x.values.to_numpy() for x in table.column("_cells")]
    size = np.array([len(x) for x in lists])
    rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out: list[tuple[bytes, bytes]] = []
    if len(rows) and len(columns):
        known = np.unique(np.concatenate([lists[c] for c in columns]))
        at = {r: np.flatnonzero(np.isin(lists[r], known, assume_unique=True)) for r in rows}
        rows = np.array([r for r in rows if len(at[r]) >= similarity * size[r]], np.int64)
        cells_ = np.unique(np.concatenate([np.zeros(0, np.int64), *[lists[r][at[r]] for r in rows]]))
        both = np.zeros((len(rows), len(columns)), np.float32)
        where = [[(k, cells_.searchsorted(lists[r][np.isin(lists[r], cells_, assume_unique=True)])) for k, r in enumerate(of)] for of in (rows, columns)]
        flat = [(np.concatenate([np.full(len(p), k) for k, p in w] or [[]]).astype(np.int64), np.concatenate([p for _, p in w] or [[]]).astype(np.int64)) for w in where]
        for lo in range(0, len(cells_), 2048):
            sides = []
            for (member, cell), of in zip(flat, (rows, columns), strict=True):
                matrix = np.zeros((len(of), 2048), np.float32)
                inside = (cell >= lo) & (cell < lo + 2048)
                matrix[member[inside], cell[inside] - lo] = 1
                sides.append(matrix)
            both += sides[0] @ sides[1].T
        near = both >= similarity * (size[rows][:, None] + size[columns][None, :] - both)
        parent: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for r, c in zip(*np.nonzero(near), strict=True):
            a, b = find(label[rows[r]]), find(label[columns[c]])
            if a != b:
                parent[a] = b
                out.append((node[rows[r]], node[columns[c]]))
    return pa.table([pa.array([max(x) for x in out], pa.binary()), pa.array([min(x) for x in out], pa.binary())], names=["a", "b"])


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row per document: id, ``class_id`` (least id of its class), ``class_size``, ``class_texts``.

    Two texts are linked when their multisets of word 5-grams have a weighted Jaccard similarity of
    ``similarity`` or more; a class is what links connect. Texts with the same words are one text from
    the start. Texts without words (null, empty, blank) form one class. Null ids are members like
    others, but name no class unless they are alone in it (then ``class_id`` is null). Repeated rows
    count each. Candidates are found by 24 bands of 5 coordinates: a pair at 0.8 is missed with a
    chance of 7e-5, before its other links.
    """
    common.ship(docs.sparkSession)
    plain = docs.select(common.named(id_col).alias("_id"), common.text_of(text).alias("_text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    sketched = session.stage(plain.mapInArrow(_sketch, f"_id {id_type}, _node binary, _bands array<bigint>"), "sketches")
    nodes = session.stage(
        sketched.groupBy("_node").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"), F.first("_bands").alias("_bands")), "texts"
    )
    rows = nodes.select("_node", F.explode("_bands").alias("key"))
    shared = session.stage(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = session.stage(common.attach(rows, shared, "key", ["n"], weight="n").filter("n IS NOT NULL").select("key", "n", F.col("_node").alias("node")), "members")

    # Exact weighted sets of the texts that share a bucket; found by id, told apart by digest.
    wanted = members.select(F.col("node").alias("_node")).distinct()
    ids = session.stage(wanted.join(nodes.select("_node", "_least"), "_node").select(F.xxhash64("_least").alias("_h"), "_node"), "candidates")
    texts = common.attach(plain.select(F.xxhash64("_id").alias("_h"), "_text"), ids.select("_h").distinct().withColumn("_hit", F.lit(1)), "_h", ["_hit"])
    regions = texts.filter("_hit = 1").select("_h", "_text").mapInArrow(_regions, "_node binary, _cells array<bigint>")
    regions = session.stage(regions.join(wanted, "_node", "left_semi").dropDuplicates(["_node"]), "regions")

    # Stars: every member is compared with the member of its bucket that shares most with others.
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    stars = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("c"), F.count("*").alias("n"))
    stars = session.stage(stars.select("key", F.col("c.node").alias("centre"), "n"), "stars")
    pairs = common.attach(members.select("key", "node"), stars, "key", ["centre", "n"], weight="n").filter("node <> centre")
    pairs = pairs.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
    linked = session.stage(_verified(pairs, regions, similarity), "links")
    labels = session.stage(components(linked), "labels")

    # Then across the classes of the buckets that still hold several.
    labelled = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = session.stage(labelled, "labelled")
    stats = labelled.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.sum("m").alias("weight"), F.sum(F.col("m") * F.col("m")).alias("inside"), F.max(F.struct("m", "label")).alias("main")
    )
    stats = session.stage(
        stats.filter("weight > main.m").select(
            "key", "weight", F.col("main.label").alias("main"),
            F.when((F.col("weight") * F.col("weight") - F.col("inside")) > 2 * PAIRS_PER_ROW * F.col("weight"), F.ceil((F.col("weight") - F.col("main.m")) / BLOCK)).otherwise(0).cast("int").alias("blocks"),
        ),
        "mixed",
    )
    mixed = common.attach(labelled, stats, "key", ["weight", "main", "blocks"], weight="weight").filter("main IS NOT NULL")
    mixed = session.stage(mixed, "mixed-members")
    # A pair across classes has a member outside the bucket's main class: those against all, here and in blocks.
    pairs = _few_pairs(mixed.filter("blocks = 0"))
    rows_of, columns_of = F.col("blocks"), F.ceil(F.col("weight") / BLOCK).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    many = mixed.filter("blocks > 0")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    left = many.filter("label <> main").select("key", "node", "label", F.lit(0).alias("side"), place(rows_of).alias("i"), spread(columns_of).alias("j"))
    right = many.select("key", "node", "label", F.lit(1).alias("side"), spread(rows_of).alias("i"), place(columns_of).alias("j"))
    blocks = left.unionByName(right).join(regions, F.col("node") == F.col("_node")).select("key", "i", "j", "side", "node", "label", "_cells")
    found = blocks.groupBy("key", "i", "j").applyInArrow(lambda t: _block_links(t, similarity), "a binary, b binary")
    more = session.stage(_verified(pairs, regions, similarity).unionByName(found.distinct()), "more-links")
    if not more.isEmpty():
        labels = session.stage(components(linked.unionByName(more)), "labels")

    named = nodes.select(F.col("_node").alias("node"), "_least", "_n")
    named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("_least").alias("class_id"), F.sum("_n").alias("class_size"), F.count("*").alias("class_texts"))
    grouped = classes.filter("class_size > 1")
    table = session.stage(named.join(grouped, "label").select(F.col("node").alias("_node"), "_n", "class_id", "class_size", "class_texts"), "classes")
    out = common.attach(sketched.select("_id", "_node"), table, "_node", ["_n", "class_id", "class_size", "class_texts"], weight="_n")
    alone = F.col("class_size").isNull()
    return out.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """The documents with one of each class, the one with the least id; all columns as they were.

    Rows that share an id share its fate, and stay if one of them names a class; null ids stay.
    """
    marked = session.stage(near_copies(docs.select(common.named(id_col).alias("_i"), common.named(text).alias("_t")), "_i", "_t", similarity), "near-copies")
    fate = marked.filter("_i IS NOT NULL").groupBy("_i").agg(F.max(F.col("_i").eqNullSafe(F.col("class_id"))).alias("stays"))
    gone = session.stage(fate.filter("NOT stays").select("_i", F.lit(True).alias("_gone")), "gone")
    rows = common.attach(common.packed(docs, _i=common.named(id_col)), gone, "_i", ["_gone"])
    return common.unpacked(rows.filter("_gone IS NULL"), docs.columns)
