"""Exact deduplication: two passes over a blocked Bloom filter, in DataFrame functions only.

Pass one folds the fingerprints into the 64-bit blocks of a Bloom filter, with the bits seen
once and the bits seen again, and keeps the blocks in which a whole fingerprint was seen
again. Pass two asks that filter: rows that it clears have no copy for certain and pass
straight through; only the fingerprints of the others are shuffled and grouped. Texts never
are. A text held by a third of all rows is one partial count per task in both passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.llm import common

#: Fingerprints per 64-bit block of the filter.
KEYS_PER_BLOCK = 2


def _bits(fingerprint: Column, blocks: int) -> tuple[Column, Column]:
    """(block, mask of three bits) of a fingerprint."""
    h = F.xxhash64(fingerprint)
    bit = [F.expr("1L").cast("long")] * 3
    masks = [
        F.call_function("shiftleft", bit[i], F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(3)
    ]
    return F.pmod(F.shiftrightunsigned(h, 18), F.lit(blocks)).alias("_block"), masks[0].bitwiseOR(masks[1]).bitwiseOR(masks[2]).alias("_mask")


def repeated_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Pass one: staged blocks (``_block``, ``_twice``) in which a fingerprint may repeat.

    ``keys`` has the fingerprints as ``_sha``. Equal fingerprints are counted before the
    shuffle; a block lists its distinct masks, of which there are two on average.
    """
    masks = keys.select(*_bits(F.col("_sha"), blocks)).groupBy("_block", "_mask").agg(F.count("*").alias("n"))
    listed = masks.groupBy("_block").agg(F.collect_list(F.struct("_mask", "n")).alias("seen"))
    twice = listed.filter("size(seen) > 1 OR seen[0].n > 1").withColumn(
        "again",
        F.expr(
            "aggregate(seen, struct(0L AS once, 0L AS again), (a, x) -> struct(a.once | x._mask AS once,"
            " a.again | (a.once & x._mask) | if(x.n > 1, x._mask, 0L) AS again), a -> a.again)"
        ),
    )
    whole = F.expr("aggregate(seen, 0L, (a, x) -> a | if((x._mask & again) = x._mask, x._mask, 0L))")
    return session.stage(twice.select("_block", whole.alias("_twice")).filter("_twice <> 0"), "bloom")


def _fingerprint(text: str) -> Column:
    return F.unhex(F.sha2(common.text_of(text), 256))


def _maybe(rows: DataFrame, repeated: DataFrame, blocks: int) -> DataFrame:
    """Pass two: adds ``_maybe``, false for rows that have no copy for certain."""
    block, mask = _bits(F.col("_sha"), blocks)
    asked = rows.select(*rows.columns, block, mask)
    small = session.measured_bytes(repeated, repeated.columns)[1] <= session.BROADCAST_BYTES
    hit = asked.join(F.broadcast(repeated) if small else repeated, "_block", "left")
    return hit.select(
        *rows.columns, F.coalesce(F.col("_twice").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)).alias("_maybe")
    )


def _groups(keys: DataFrame, repeated: DataFrame, blocks: int) -> DataFrame:
    """Staged ``_sha``, ``_keep``, ``_n``, ``_tie`` of the texts that do occur more than once."""
    found = _maybe(keys, repeated, blocks).filter("_maybe").groupBy("_sha", "_id").agg(F.count("*").alias("m"))
    best = found.groupBy("_sha").agg(
        F.max("_id").alias("_keep"), F.sum("m").alias("_n"), F.max_by("m", "_id").alias("_tie"), F.sum(F.when(F.col("_id").isNull(), F.col("m"))).alias("_nulls")
    )
    return session.stage(
        best.filter("_n > 1").select("_sha", "_keep", "_n", F.coalesce("_tie", "_nulls").alias("_tie")), "copies"
    )


def _with_groups(rows: DataFrame, repeated: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """Adds ``_keep``, ``_n`` and ``_tie``; rows that the filter clears do not shuffle."""
    payload = ["_keep", "_n", "_tie"]
    marked = _maybe(rows, repeated, blocks)
    clear = marked.filter("NOT _maybe").select(
        *rows.columns, F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"), F.lit(1).cast("long").alias("_tie")
    )
    maybe = common.attach(marked.filter("_maybe").drop("_maybe"), groups, "_sha", payload, weight="_n")
    single = F.col("_n").isNull()
    maybe = maybe.select(
        *rows.columns,
        F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("_keep"),
        F.coalesce("_n", F.lit(1)).alias("_n"),
        F.coalesce("_tie", F.lit(1)).alias("_tie"),
    )
    return clear.unionByName(maybe)


def _prepare(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    keys = session.stage(docs.select(common.named(id_col).alias("_id"), _fingerprint(text).alias("_sha")), "fingerprints")
    blocks = max(1, keys.count() // KEYS_PER_BLOCK)
    repeated = repeated_filter(keys, blocks)
    return keys, repeated, _groups(keys, repeated, blocks), blocks


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with
    the largest id stays. Rows that repeat both id and text are one document: all are marked
    as kept and counted in ``group_size`` (``drop_copies`` leaves one of them). A null id loses
    to any other; a group with null ids only keeps a null id. Other columns are not read.
    """
    keys, repeated, groups, blocks = _prepare(docs, id_col, text)
    out = _with_groups(keys, repeated, groups, blocks)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their copies, all columns as they were.

    The choice is that of ``mark_copies``; of rows that repeat the kept id and text, one stays.
    """
    _, repeated, groups, blocks = _prepare(docs, id_col, text)
    rows = common.packed(docs, _id=common.named(id_col), _sha=_fingerprint(text))
    marked = _with_groups(rows, repeated, groups, blocks).filter(F.col("_id").eqNullSafe(F.col("_keep")))
    ties = marked.filter("_tie > 1").groupBy("_sha").agg(F.first("_row").alias("_row")).select("_row")
    return common.unpacked(marked.filter("_tie = 1").select("_row").unionByName(ties), docs.columns)
