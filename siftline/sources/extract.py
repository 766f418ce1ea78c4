"""Extracting rows of an object, with relationships made flat."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators import lookup


def extract(
    df: DataFrame,
    mode: str = "all",
    columns: list[str] | None = None,
    created: str | None = None,
    days_back: int | None = None,
    as_of: dt.date | None = None,
    limit: int | None = None,
    query: str | None = None,
) -> DataFrame:
    """``all`` rows (up to a limit if one is given), ``recent`` rows of the last days, or a ``custom`` query.

    Recent means created on or after midnight of ``as_of`` minus ``days_back``.
    A custom query reads the frame as ``source``.
    """
    wanted = [F.col(c) for c in columns] if columns else [F.col("*")]
    if mode == "custom":
        return df.sparkSession.sql(query, source=df)
    if mode == "recent":
        start = as_of - dt.timedelta(days=days_back)
        return df.filter(F.col(created) >= F.lit(dt.datetime.combine(start, dt.time())).cast("timestamp_ntz")).select(*wanted)
    if mode == "all":
        out = df.select(*wanted)
        return out if limit is None else out.limit(limit)
    raise ValueError(f"unknown extract mode: {mode}")


def reference_key(parent_catalog: DataFrame) -> str:
    """Field that identifies a parent: its external id, else a unique field, else Name.

    The parent's first external id counts; of its unique fields (other than Id)
    the last one. First and last are by the catalogue's ``position`` column if it
    has one, else by the order of its rows.
    """
    place = F.col("position") if "position" in parent_catalog.columns else F.monotonically_increasing_id()
    external = F.coalesce(F.col("external_id"), F.lit(False))
    unique = F.coalesce(F.col("is_unique"), F.lit(False)) & (F.col("name") != "Id") & ~external
    found = parent_catalog.select("name", external.alias("external"), unique.alias("unique"), place.alias("place")).agg(
        F.min_by("name", F.when(F.col("external"), F.col("place"))).alias("external"),
        F.max_by("name", F.when(F.col("unique"), F.col("place"))).alias("unique"),
    ).first()
    return found["external"] or found["unique"] or "Name"


def extract_with_reference_keys(
    df: DataFrame, references: list[tuple[str, DataFrame, DataFrame]], id_field: str = "Id", limit: int | None = None
) -> DataFrame:
    """Adds ``<column>.<key>`` of the parent row for every reference column.

    ``references`` holds (column, parent rows, parent catalogue).
    """
    specs = [(column, parent, id_field, reference_key(cat)) for column, parent, cat in references]
    out = df if limit is None else df.limit(limit)
    return lookup.with_reference_keys(out, specs)


def _shown(c: Column, dtype: T.StructType) -> Column:
    """Name, else ExternalId, else Id, else the whole struct as JSON text."""
    names = dtype.fieldNames()
    picks = [c[n].cast("string") for n in ("Name", "ExternalId", "Id") if n in names]
    return F.when(c.isNotNull(), F.coalesce(*picks, F.to_json(c)))


def flatten_relationships(df: DataFrame) -> DataFrame:
    """Drops ``attributes`` and replaces every struct column by one value."""
    return df.select(
        *[
            (_shown(F.col(f"`{f.name}`"), f.dataType) if isinstance(f.dataType, T.StructType) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
            if f.name != "attributes"
        ]
    )


def parse_relationship(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column as a struct, ready for ``flatten_relationships``."""
    return df.withColumn(column, F.from_json(F.col(column), schema))
