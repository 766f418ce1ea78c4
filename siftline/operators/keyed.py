"""Attaching a per-key table to rows without trusting the key distribution.

One value may sit in a third of all rows, so a plain shuffle join on it would
send a third of the data to one task. Here the per-key table carries the number
of rows of each key; a small table is broadcast after it was measured, a large
one is split into its heavy keys (few, by counting) and the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.functions.values import group_key

#: At most this many keys can hold 1/HEAVY_KEYS of all rows each.
HEAVY_KEYS = 50_000
#: Rows without a match are spread over this many shuffle keys.
SPREAD = 4096


def key_counts(df: DataFrame, key: Column, out: str = "rows") -> DataFrame:
    """One row per non-null key with its number of rows (map-side combined)."""
    return df.select(key.alias("key")).filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.count("*").alias(out)
    )


def attach_by_key(
    rows: DataFrame,
    key: Column,
    table: DataFrame,
    payload: list[str],
    weight: str | None = None,
    broadcast_bytes: int | None = None,
    heavy_keys: int = HEAVY_KEYS,
    fits: bool | None = None,
) -> DataFrame:
    """Left-join ``table`` (columns ``key`` + payload, one row per key) to ``rows``.

    ``table`` must be staged (see ``session.stage``). ``weight`` names its column
    with the number of rows per key; without it a table too large to broadcast is
    joined by shuffle, with Spark's own skew handling. ``fits`` says that the caller
    has measured the table, or one that holds it, against the limit.
    """
    limit = session.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if fits is None:
        fits = session.measured_bytes(table, ["key", *payload])[1] <= limit
    keyed = rows.withColumn("_key", key)
    if fits:
        small = F.broadcast(table.select(F.col("key").alias("_k"), *payload))
        return keyed.join(small, F.col("_key") == F.col("_k"), "left").drop("_key", "_k")
    if weight is None:
        large = table.select(F.col("key").alias("_k"), *payload)
        spread = _spread_nulls(keyed, F.col("_key"))
        return spread.join(
            large.withColumn("_ks", F.lit(0)), (F.col("_cold") == F.col("_k")) & (F.col("_salt") == F.col("_ks")), "left"
        ).drop("_key", "_k", "_ks", "_cold", "_salt")

    total = table.agg(F.sum(weight)).first()[0] or 0
    # Fewer than heavy_keys keys can reach this share. Payloads may be long, so of these keys
    # the most frequent are taken whose measured sizes add up to the limit.
    most = table.filter(F.col(weight) * heavy_keys > total)
    size_of = sum((F.coalesce(F.octet_length(F.col(p).cast("string")), F.lit(0)) for p in ["key", *payload]), F.lit(16))
    ranked = most.select("key", size_of.alias("size"), F.col(weight).alias("w")).orderBy(F.desc("w"), "key").collect()
    room, least = max(limit, session.BROADCAST_BYTES), None
    for r in ranked:
        room -= r["size"]
        if room < 0:
            break
        least = r["w"]
    heavy = most.filter(F.lit(False) if least is None else F.col(weight) >= least)
    heavy = F.broadcast(
        heavy.select(F.col("key").alias("_hk"), *[F.col(p).alias(f"_h_{p}") for p in payload])
    )
    joined = keyed.join(heavy, F.col("_key") == F.col("_hk"), "left")
    cold_key = F.when(F.col("_hk").isNull(), F.col("_key"))
    spread = _spread_nulls(joined, cold_key)
    rest = table.select(
        F.col("key").alias("_k"), F.lit(0).alias("_ks"), *[F.col(p).alias(f"_c_{p}") for p in payload]
    )
    out = spread.join(rest, (F.col("_cold") == F.col("_k")) & (F.col("_salt") == F.col("_ks")), "left")
    return out.select(
        *rows.columns,
        *[F.when(F.col("_hk").isNotNull(), F.col(f"_h_{p}")).otherwise(F.col(f"_c_{p}")).alias(p) for p in payload],
    )


def _spread_nulls(df: DataFrame, key: Column) -> DataFrame:
    """Rows that cannot match get a salt instead of all meeting at key null."""
    salt = F.pmod(session.content_hash(df), F.lit(SPREAD)).cast("int") + 1
    return df.withColumn("_cold", key).withColumn("_salt", F.when(F.col("_cold").isNull(), salt).otherwise(F.lit(0)))


def duplicate_counts(df: DataFrame, column: Column, ignore: Column | None = None) -> DataFrame:
    """Staged table (key, rows) of the values that occur more than once."""
    key = group_key(column)
    if ignore is not None:
        key = F.when(~ignore, key)
    return session.stage(key_counts(df, key).filter(F.col("rows") > 1), "duplicates")


def repeated_values(df: DataFrame, columns: list[tuple[Column, Column]]) -> DataFrame:
    """Staged (``position``, ``key``, ``rows``) of the values that repeat, of all (value, ignore) columns in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("position"), F.when(~ignore, group_key(value)).alias("key")) for i, (value, ignore) in enumerate(columns)
    ])
    long = df.select(F.inline(pairs)).filter(F.col("key").isNotNull())
    return session.stage(long.groupBy("position", "key").agg(F.count("*").alias("rows")).filter("rows > 1"), "repeated")


def attach_repeated(df: DataFrame, value: Column, repeated: DataFrame, position: int, out: str) -> DataFrame:
    """Adds how many rows share the row's value, from ``repeated_values``: null when it is the only one."""
    counts = repeated.filter(F.col("position") == position).select("key", F.col("rows").alias(out))
    return attach_by_key(df, group_key(value), counts, [out], weight=out)


def attach_duplicate_count(df: DataFrame, column: Column, out: str, ignore: Column | None = None) -> DataFrame:
    """Adds how many rows share the row's value: null when it is the only one.

    The values are counted in a first, map-side combined pass over one column;
    the rows themselves are not shuffled unless the duplicate values are many.
    """
    counts = duplicate_counts(df, column, ignore).withColumnRenamed("rows", out)
    return attach_by_key(df, group_key(column), counts, [out], weight=out)
