"""Mixing sources to target weights by a minimum-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. Words flow from these
patterns to the sources' quotas; the k-th repetition of a word costs k, so the cost is convex
and the flow repeats no more than it must. Within a pattern, documents are taken in a seeded
order until its flow is used up. Only the aggregates of patterns reach the driver.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Most membership patterns (sets of sources, not documents) that the driver routes.
MAX_PATTERNS = 200_000


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0, total: int | None = None) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all sizes (or of ``total``) by weight, none above ``most`` times its size.

    What a stopped source leaves is shared by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * (sum(sizes.values()) if total is None else total), list(order)
    while open_:
        parts = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / parts > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / parts for s in open_}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(patterns: list[tuple[tuple, int]], quota: dict, repeats: int) -> list[dict]:
    """Words of each pattern for each of its sources, at the least total repetition.

    Successive shortest paths with potentials. Arcs: start to pattern (one per repetition, with
    the pattern's words as capacity and the repetition's number as cost), pattern to its sources,
    source to end (its quota). Ties go to the first arc, so reruns agree.
    """
    sources = list(quota)
    n = len(patterns) + len(sources) + 2
    start, end = n - 2, n - 1
    place = {s: len(patterns) + i for i, s in enumerate(sources)}
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, most: int, price: int) -> None:
        for x, y, m, c in ((a, b, most, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y)
            room.append(m)
            cost.append(c)

    used: list[tuple[int, object, int]] = []
    for i, (members, size) in enumerate(patterns):
        for k in range(repeats):
            arc(start, i, size, k)
        for s in members:
            used.append((i, s, len(to)))
            arc(i, place[s], size * repeats, 0)
    for s in sources:
        arc(place[s], end, quota[s], 0)
    potential = [0] * n
    while True:
        far = [math.inf] * n
        via = [-1] * n
        far[start], heap = 0, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in head[x]:
                if room[e] and (new := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if far[end] == math.inf:
            break
        potential = [p + min(f, far[end]) for p, f in zip(potential, far, strict=True)]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    flows: list[dict] = [{} for _ in patterns]
    for i, s, e in used:
        if room[e ^ 1]:
            flows[i][s] = room[e ^ 1]
    return flows


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 17, whole_rows: bool = False,
) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target``, ``taken``.

    With ``whole_rows`` the document itself comes as the struct ``_row`` in place of the id.

    ``source`` is one source or an array of overlapping ones; a null or empty one is the source
    null, which comes last. ``source_size`` and ``target`` are sums over the document's sources.
    ``taken`` is ``size`` times the repetitions, at most ``repeats``; whole documents are taken,
    so a pattern's words are within half a document of its flow. A null text has no words and is
    never taken. Repeated rows are documents of their own. An empty table gives an empty one.
    """
    kind = docs.schema[source].dataType.typeName()
    listed = common.named(source) if kind == "array" else F.array(common.named(source).cast("string"))
    listed = F.sort_array(F.array_distinct(F.coalesce(listed, F.array(F.lit(None).cast("string")))), asc=False)
    listed = F.when(F.size(listed) == 0, F.array(F.lit(None).cast("string"))).otherwise(listed)
    own = {
        "_pattern": listed, "_size": F.regexp_count(common.text_of(text), F.lit(WORD)).cast("long"),
        "_order": F.xxhash64(F.lit(seed), common.named(id_col), common.named(text)),
    }
    slim = session.stage(docs.select(common.named(id_col).alias("_row"), *[c.alias(k) for k, c in own.items()]), "mix-sizes")
    rows = common.packed(docs, **own) if whole_rows else slim
    aggregated = slim.groupBy("_pattern").agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
    found = session.bounded_collect(aggregated, MAX_PATTERNS, "sets of sources")
    found = sorted(((tuple(r["_pattern"]), int(r["size"]), int(r["n"])) for r in found), key=lambda p: [(s is None, s or "") for s in p[0]])
    sizes: dict[str | None, int] = {}
    for members, size, _ in found:
        for s in members:
            sizes[s] = sizes.get(s, 0) + size
    wanted = targets(sizes, weights, share, float(repeats), sum(size for _, size, _ in found))
    flows = min_cost_flow([(p, size) for p, size, _ in found], {s: round(t) for s, t in wanted.items()}, repeats)
    # Buckets of the seeded order: about sqrt(n) of them, with sqrt(n) documents each.
    bits = max(1, math.ceil(math.log2(max(2, sum(n for *_, n in found))) / 2))
    plan_rows = []
    for number, ((members, size, _), flow) in enumerate(zip(found, flows, strict=True)):
        total = sum(flow.values())
        plan_rows.append((number, list(members), sum(sizes[s] for s in members), float(sum(wanted[s] for s in members)), total // size if size else 0, total % size if size else 0))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan_rows, "number int, pattern array<string>, source_size long, target double, whole long, part long")
    plan = F.broadcast(plan)
    # Null-safe on the array's JSON form: arrays with null members do not compare equal.
    key = lambda c: F.to_json(F.struct(F.transform(c, lambda x: F.struct(x.isNull().alias("n"), x.alias("s"))).alias("p")))
    plan = plan.withColumn("_key", key(F.col("pattern"))).drop("pattern")

    def planned(df: DataFrame) -> DataFrame:
        return df.join(plan, key(F.col("_pattern")) == F.col("_key"), "left").withColumn("_bucket", F.shiftrightunsigned("_order", 64 - bits))

    rows = planned(rows)
    sums = planned(slim).groupBy("number", "_bucket", "part").agg(F.sum("_size").alias("s"))
    before = F.sum("s").over(Window.partitionBy("number").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    edge = sums.withColumn("base", F.coalesce(before, F.lit(0))).filter("base <= part AND base + s > part")
    edge = session.stage(edge.select(F.col("number").alias("_n"), F.col("_bucket").alias("_edge"), "base"), "mix-edge")
    rows = rows.join(F.broadcast(edge), F.col("number") == F.col("_n"), "left")
    sure = rows.filter("_edge IS NULL OR _bucket <> _edge").withColumn("_more", (F.col("_bucket") < F.col("_edge")).cast("long"))
    # Only the bucket in which a pattern's flow ends is put in order: one in sqrt(n) documents.
    upto = F.sum("_size").over(Window.partitionBy("number").orderBy("_order", "_size").rowsBetween(Window.unboundedPreceding, 0))
    close = rows.filter("_bucket = _edge").withColumn("_upto", F.col("base") + upto)
    close = close.withColumn("_more", (2 * F.col("_upto") - F.col("_size") <= 2 * F.col("part")).cast("long")).drop("_upto")
    return sure.unionByName(close).select(
        F.col("_row").alias("_row" if whole_rows else id_col), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * (F.col("whole") + F.coalesce("_more", F.lit(0)))).alias("taken"),
    )


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes at least once, all columns as they were."""
    return common.unpacked(mix(docs, whole_rows=True, **options).filter("taken > 0"), docs.columns)
