"""Cleaning values before a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import values

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
PLAIN = "yyyy-MM-dd HH:mm:ss"


def _clean(c: Column, dtype: T.DataType, date_format: str, strip: bool) -> Column:
    if isinstance(dtype, T.StringType):
        stripped = values.strip(c)
        kept = F.when((F.lower(stripped) != "nan") & ((stripped != "") | F.lit(not strip)), stripped if strip else c)
        return kept
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, date_format)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda e: _clean(e, dtype.elementType, date_format, strip))
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(
            *[_clean(c[f.name], f.dataType, date_format, strip).alias(f.name) for f in dtype.fields]
        )
        return F.when(c.isNotNull(), rebuilt)
    return c


def clean_values(df: DataFrame, date_format: str = ISO, strip: bool = True) -> DataFrame:
    """Text stripped, blank / "nan" / infinite to null, timestamps to text.

    Works through structs and arrays. ``strip=False`` keeps text as it is and
    only drops "nan".
    """
    return df.select(
        *[
            _clean(F.col(f"`{f.name}`"), f.dataType, date_format, strip).alias(f.name.strip())
            for f in df.schema.fields
        ]
    )


def coerce_bool(df: DataFrame, columns: list[str], short_tokens: bool = True) -> DataFrame:
    """Columns to boolean by token; numbers other than 1 and 0, and other text, to null."""
    out = {}
    for name in columns:
        c = values.cell(df, name)
        if c.is_boolean:
            continue
        if c.is_numeric:
            out[name] = F.when(c.value == 1, F.lit(True)).when(c.value == 0, F.lit(False))
        else:
            out[name] = values.boolean(c.value, short_tokens)
    return df.withColumns(out) if out else df


def json_compliance(df: DataFrame) -> DataFrame:
    """Columns with NaN or infinite cells: (column, bad_cells). Empty = compliant."""
    names = [c.name for c in values.cells(df) if c.is_fractional]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, bad_cells long")
    bad = [
        F.count_if(F.isnan(F.col(f"`{n}`")) | (F.abs(F.col(f"`{n}`")) == F.lit(float("inf")))).alias(f"c{i}")
        for i, n in enumerate(names)
    ]
    pairs = F.array(
        *[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("bad_cells")) for i, n in enumerate(names)]
    )
    return df.agg(*bad).select(F.inline(pairs)).filter("bad_cells > 0")


def is_json_compliant(df: DataFrame) -> bool:
    return json_compliance(df).isEmpty()


def fill_required(df: DataFrame, nullable: list[str]) -> DataFrame:
    """Nulls of non-nullable columns: text to '', numbers to 0, booleans to false."""
    out = {}
    for c in values.cells(df):
        if c.name in nullable:
            continue
        if c.is_text:
            out[c.name] = F.coalesce(c.value, F.lit(""))
        elif c.is_numeric:
            filled = F.nanvl(c.value, F.lit(0.0)) if c.is_fractional else c.value
            out[c.name] = F.coalesce(filled, F.lit(0)).cast(c.dtype)
        elif c.is_boolean:
            out[c.name] = F.coalesce(c.value, F.lit(False))
    return df.withColumns(out) if out else df
