"""Helpers shared by the text operators: attaching per-key tables, blocks of text bytes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import session

#: At most this many keys can each hold 1/HEAVY of all rows, so a table of them is bounded.
HEAVY = 50_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Bytes of text that one numpy block holds (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20


def mapped_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, as a path that every worker can open and map."""
    root = session.shared_dir(spark)
    if "://" in root or root.startswith("file:"):
        scheme, _, path = root.partition(":")
        if scheme != "file":
            raise ValueError(f"memory-mapped arrays need a mounted shared folder, not {scheme}:")
        root = "/" + path.lstrip("/")
    path = f"{root}/siftline-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def give_back() -> None:
    """Returns freed memory to the system; Spark keeps its Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors the package's code, once per application: it need not be installed there."""
    # Texts are long: batches between the JVM and Python are small, as both sides hold several.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="siftline-code-"), "siftline_code.zip")
    with zipfile.ZipFile(path, "w") as file:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    file.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def named(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """The rows as one struct ``_row`` beside columns of our own: names cannot clash."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("_row"), *[c.alias(k) for k, c in extra.items()])


def unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in names])


def text_of(column: str) -> Column:
    return F.coalesce(named(column).cast("string"), F.lit(""))


def attach(rows: DataFrame, table: DataFrame, key: str, payload: list[str], weight: str | None = None) -> DataFrame:
    """Left-join a staged one-row-per-key ``table`` to ``rows`` on ``key``.

    A table measured to be small is broadcast. Of a larger one, the keys that hold
    more than 1/HEAVY of ``weight`` are broadcast (fewer than HEAVY of them exist),
    and the rest is joined by shuffle, so no key gathers a large share in one task.
    Rows whose key is null match nothing.
    """
    table = table.select(key, *payload)
    _, size = session.measured_bytes(table, table.columns)
    if size <= session.BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, "left")
    if weight is None:
        return rows.join(table, key, "left")
    total = table.agg(F.sum(weight)).first()[0]
    plain = [c for c, kind in rows.dtypes if "map<" not in kind]  # maps cannot be hashed
    heavy = table.filter(F.col(weight) * HEAVY > total).select(
        F.col(key).alias("_hk"), *[F.col(p).alias(f"_h_{p}") for p in payload]
    )
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    salt = F.when(F.col("_hk").isNotNull(), F.pmod(F.xxhash64(*plain), F.lit(4096)).cast("int") + 1).otherwise(F.lit(0))
    rest = table.select(F.col(key).alias("_k"), F.lit(0).alias("_ks"), *[F.col(p).alias(f"_c_{p}") for p in payload])
    joined = marked.withColumn("_salt", salt).join(
        rest, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_ks")), "left"
    )
    found = [F.coalesce(F.col(f"_h_{p}"), F.col(f"_c_{p}")).alias(p) for p in payload]
    return joined.select(*rows.columns, *found)


def parts(n_bytes: float, each: int, least: int = 1) -> int:
    """How many parts of ``each`` bytes: grows with the data, so a part does not."""
    return max(least, int(-(-n_bytes // each)))


# --- blocks of text ---------------------------------------------------------------------


def text_blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes."""
    text = batch.column(column)
    if not pa.types.is_large_binary(text.type):
        text = text.cast(pa.large_string()).cast(pa.large_binary())
    if text.null_count:
        text = pc.fill_null(text, b"")
    if not len(text):
        return
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        hi = min(hi, len(text))
        yield lo, hi, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finalizer of splitmix64)."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
        if len(have) > 4 * BLOCK_BYTES:
            del _powers[base]
    return have


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, 64-bit hash) of each word ``[^\\x20\\x09-\\x0D]+`` of a block.

    The hash is a polynomial over the word's bytes, taken from prefix sums: no
    Python object per word. ``table`` maps bytes to values (and can fold case).
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = np.empty(n + 1, bool)
    inside[:n] = ~IS_SPACE[data]
    inside[n] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside[:n].copy()
    starts[1:] &= ~inside[: n - 1] | edge[1:n]
    ends = inside[:n] & (~inside[1:] | edge[1:])
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * powers(_BASE, n)[:n], out=sums[1:])
    code = mix((sums[end] - sums[start]) * powers(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))
    return np.searchsorted(offsets, start, "right") - 1, start, end, code


def folded() -> np.ndarray:
    """A byte table under which A-Z hash as a-z."""
    table = _BYTE.copy()
    table[65:91] = table[97:123]
    return table


def bounds_by_document(document: np.ndarray, n: int) -> np.ndarray:
    """Where each document's words begin in a sorted list of document numbers (n + 1 values)."""
    return np.searchsorted(document, np.arange(n + 1))
