"""Column profiles, data-quality issues and inferred types.

Counts that need no grouping are one aggregate over the scan, in slices of
columns so that generated code stays small. Exact distinct counts group
(column, value) pairs once for all columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.functions import fixed, values
from siftline.functions.values import Cell

#: Columns per aggregate.
SLICE = 50
#: Rows of a table's first file in which samples are looked for before the rest.
HEAD_ROWS = 100
#: Sketches of distinct values have 2 to this power registers: a standard error of about 1.04 / 2 ** (bits / 2).
SKETCH_BITS = 12


def _long(df: DataFrame, per_column: dict[str, dict[str, Column]], extra: dict[str, Column] | None = None) -> DataFrame:
    """One aggregate per slice of columns, turned to one row per column.

    ``per_column`` gives the named facts of each column: aggregates, or constants
    known from its type (wrapped in ``Known``), which cost nothing per row.
    ``extra`` are further aggregates repeated on every row. Length, stripped text
    and number are worked out once per cell, as ``_length_<n>``, ``_stripped_<n>``
    and ``_number_<n>`` of the n-th column.
    """
    names = list(per_column)
    parts = []
    for start in range(0, len(names), SLICE):
        chunk = names[start : start + SLICE]
        sized = df.select(
            *[F.col(f"`{n}`") for n in chunk],
            *[F.length(F.col(f"`{n}`").cast("string")).alias(_length_name(start + i)) for i, n in enumerate(chunk)],
            *[
                values.strip(F.col(f"`{n}`")).alias(_stripped_name(start + i))
                for i, n in enumerate(chunk)
                if values.cell(df, n).is_text
            ],
        )
        sized = sized.select(
            "*",
            *[
                values.stripped_number(_stripped_name(start + i)).alias(_number_name(start + i))
                for i, n in enumerate(chunk)
                if values.cell(df, n).is_text
            ],
        )
        aggs, structs = [], []
        for i, name in enumerate(chunk):
            members = [F.lit(start + i).alias("position"), F.lit(name).alias("column")]
            for label, fact in per_column[name].items():
                if isinstance(fact, Known):
                    members.append(fact.value.alias(label))
                else:
                    aggs.append(fact.alias(f"{label}_{i}"))
                    members.append(F.col(f"{label}_{i}").alias(label))
            structs.append(F.struct(*members))
        shared = [e.alias(label) for label, e in (extra or {}).items()]
        parts.append(sized.agg(*(aggs + shared or [F.count("*")])).select(*(extra or {}), F.inline(F.array(*structs))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Known:
    """A fact that follows from the column type."""

    value: Column


def _length_name(position: int) -> str:
    return f"_length_{position}"


def _stripped_name(position: int) -> str:
    return f"_stripped_{position}"


def _number_name(position: int) -> str:
    return f"_number_{position}"


# --- types ----------------------------------------------------------------------------


def _type_facts(c: Cell, position: int) -> dict[str, Column | Known]:
    here = ~c.missing
    facts: dict[str, Column | Known] = {
        "non_null": F.count(F.when(here, 1)),
        "longest": F.max(_length_name(position)),
    }
    if c.is_text:
        name, n = session.sql_name(c.name), F.col(_number_name(position))
        token = (F.octet_length(c.value) <= 8) & F.lower(c.value).isin(fixed.DETECT_BOOLEAN)
        facts |= {
            "numeric": F.every(F.when(here, n.isNotNull())),
            "whole": F.every(F.when(here, F.coalesce((n == F.floor(n)) & (F.abs(n) != F.lit(float("inf"))), F.lit(False)))),
            "token": F.every(F.when(here, token)),
            "date": F.every(F.when(here, values.stripped_timestamp(_stripped_name(position)).isNotNull())),
            **{
                label: F.expr(f"some({name} RLIKE {session.sql_text(pattern)})")
                for label, pattern in (("email", fixed.DETECT_EMAIL), ("phone", fixed.DETECT_PHONE), ("url", fixed.DETECT_URL))
            },
        }
        return facts
    no = Known(F.lit(False))
    fractional = F.every(F.when(here, F.coalesce(c.value == F.floor(c.value), F.lit(False))))
    return facts | {
        "numeric": Known(F.lit(c.is_numeric)),
        "whole": Known(F.lit(True)) if not c.is_numeric or c.is_whole else fractional,
        "token": Known(F.lit(c.is_boolean)),
        "date": Known(F.lit(c.is_date)),
        "email": no,
        "phone": no,
        "url": no,
    }


def _detected() -> Column:
    longest = F.col("longest")
    return (
        F.when(F.col("non_null") == 0, "Text")
        .when(F.col("numeric") & F.col("whole"), "Number (Integer)")
        .when(F.col("numeric"), "Number (Decimal)")
        .when(F.col("token"), "Checkbox (Boolean)")
        .when(F.col("date"), "Date/DateTime")
        .when(F.col("email"), "Email")
        .when(F.col("phone"), "Phone")
        .when(F.col("url"), "URL")
        .when(longest <= 80, "Text (Short)")
        .when(longest <= 255, "Text (Medium)")
        .when(longest <= 32000, "Text (Long)")
        .otherwise("Text Area (Rich)")
    )


def detect_types(df: DataFrame) -> DataFrame:
    """(column, detected_type), by all or any of the column's values."""
    facts = {c.name: _type_facts(c, i) for i, c in enumerate(values.cells(df))}
    return _long(df, facts).select("column", _detected().alias("detected_type"))


def infer_sql_types(df: DataFrame) -> DataFrame:
    """(column, sql_type) wide enough for the data."""
    none = F.lit(None)
    facts = {}
    for i, c in enumerate(values.cells(df)):
        facts[c.name] = {
            "family": Known(F.lit(_family(c))),
            "top": F.max(c.value).cast("double") if c.is_whole else Known(none.cast("double")),
            "longest": F.max(_length_name(i)) if c.is_text else Known(none.cast("int")),
        }
    top, n = F.coalesce("top", F.lit(0.0)), F.col("longest")
    whole = F.when(top <= 127, "TINYINT").when(top <= 32767, "SMALLINT").when(top <= 2147483647, "INT").otherwise("BIGINT")

    def varchar(size: Column) -> Column:
        return F.concat(F.lit("VARCHAR("), size.cast("string"), F.lit(")"))

    text = (
        F.when(n.isNull(), "VARCHAR(255)")
        .when(n <= 50, varchar(F.greatest(n * 2, F.lit(50))))
        .when(n <= 255, varchar(n * 2))
        .when(n <= 4000, varchar(n))
        .otherwise("TEXT")
    )
    family = F.col("family")
    kind = (
        F.when(family == "int", whole)
        .when(family == "float", "FLOAT")
        .when(family == "bool", "BIT")
        .when(family == "datetime", "DATETIME2")
        .when(family == "text", text)
        .otherwise("VARCHAR(255)")
    )
    return _long(df, facts).select("column", kind.alias("sql_type"))


def _family(c: Cell) -> str:
    if c.is_whole:
        return "int"
    if c.is_numeric:
        return "float"
    if c.is_boolean:
        return "bool"
    if c.is_date:
        return "datetime"
    return "text" if c.is_text else "other"


# --- profiles ----------------------------------------------------------------------------


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, key, rows) of every distinct non-null value of every column.

    One shuffle for all columns; values are combined before it, so a frequent
    value is one row per map task. Long texts travel as digests.
    """
    cells = values.cells(df, columns)
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.when(~c.missing, values.group_key(_equality_text(c))).alias("key"),
            )
            for i, c in enumerate(cells)
        ]
    )
    long = df.select(F.inline(pairs)).filter(F.col("key").isNotNull())
    return long.groupBy("position", "key").agg(F.count("*").alias("rows"))


def _equality_text(c: Cell) -> Column:
    """Text that is equal exactly when the values are (0.0 equals -0.0)."""
    return (c.value + F.lit(0.0)).cast("string") if c.is_fractional else c.text


def column_profile(df: DataFrame, approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """Per column: type, detected type, counts, distinct values, text lengths, samples.

    ``approx=True`` estimates the distinct counts in the same scan, without a
    shuffle. Samples are the first two values in the order of the table (``first_values``).
    """
    cells = values.cells(df)
    facts = {}
    for i, c in enumerate(cells):
        here = ~c.missing
        shown = F.when(here, c.value)
        facts[c.name] = _type_facts(c, i) | {
            "data_type": Known(F.lit(c.dtype.simpleString())),
            "nulls": F.count(F.when(c.missing, 1)),
            "min_length": F.min(F.when(here, F.col(_length_name(i)))).cast("long"),
            "max_length": F.max(F.when(here, F.col(_length_name(i)))).cast("long"),
        }
        if approx:
            facts[c.name]["distinct_values"] = F.approx_count_distinct(shown, rsd)
    # A table in few files is dealt over all cores; its places, for the samples, are those of the files.
    wide = session.spread(df) if session.from_files(df) else df
    stats = _long(wide, facts).withColumn("detected_type", _detected())
    if not approx:
        distinct = value_counts(wide).groupBy("position").agg(F.count("*").alias("distinct_values"))
        stats = stats.join(distinct, "position", "left").withColumn(
            "distinct_values", F.coalesce("distinct_values", F.lit(0))
        )
    texts = [(i, ", ".join(found) if found else None) for i, found in enumerate(first_values(df))]
    samples = F.col("samples")
    stats = stats.join(F.broadcast(df.sparkSession.createDataFrame(texts, "position int, samples string")), "position")
    return stats.select(
        "column", "data_type", "detected_type", "non_null", "nulls", "distinct_values",
        "min_length", "max_length", samples,
    )


def first_values(df: DataFrame) -> list[list[str]]:
    """The first two values of each column, as text, in the order of the table (``session.placed``).

    The head of the first file mostly has them; only columns that have fewer there are looked for in the
    whole table, by a minimum of the places of their values and a second one beyond it. Runs jobs.
    """
    rows = session.placed(df)
    shown = [c.name for c in values.cells(df)]
    files = sorted(rows.inputFiles())
    found: list[list[str]] = [[] for _ in shown]
    if files:
        # The two sources of a file's name write its scheme with one slash or three.
        plain = F.regexp_replace("_place.file", "^[A-Za-z0-9]+:/+", "/")
        head = rows.filter((plain == re.sub("^[A-Za-z0-9]+:/+", "/", files[0])) & (F.col("_place.row") < HEAD_ROWS))
        firsts = [F.slice(F.array_sort(F.collect_list(_valued(n))), 1, 2).alias(f"f{i}") for i, n in enumerate(shown)]
        found = [[v["value"] for v in values_] for values_ in head.agg(*firsts).first()]
    few = [i for i in range(len(shown)) if len(found[i]) < 2]
    if few:
        one = rows.agg(*[F.min(_valued(shown[i])).alias(f"f{i}") for i in few]).first()
        left = [i for i in few if one[f"f{i}"] is not None]
        found = [([one[f"f{i}"]["value"]] if i in left else []) if i in few else v for i, v in enumerate(found)]
        if left:
            def beyond(i: int) -> Column:
                first = one[f"f{i}"]["place"]
                place = F.struct(F.lit(first["file"]).alias("file"), F.lit(first["row"]).alias("row"))
                return F.min(F.when(F.col("_place") > place, _valued(shown[i]))).alias(f"f{i}")

            two = rows.agg(*[beyond(i) for i in left]).first()
            for i in left:
                found[i] += [two[f"f{i}"]["value"]] if two[f"f{i}"] is not None else []
    return found


def _valued(name: str) -> Column:
    """A cell's place and text, null where it has no value."""
    text = session.sql_column(name).cast("string")
    return F.when(text.isNotNull(), F.struct(F.col("_place").alias("place"), text.alias("value")))


def profile_parts(df: DataFrame, part: Column) -> DataFrame:
    """A mergeable profile: one row per part and column, its distinct values as a sketch.

    Parts can be profiled as they arrive and kept; ``merge_profiles`` never reads their rows again.
    """
    cells = values.cells(df)
    out = None
    for start in range(0, len(cells), SLICE):
        aggregates, structs = [], []
        for i, c in enumerate(cells[start : start + SLICE]):
            shown = F.when(~c.missing, _equality_text(c))
            size = F.length(F.when(~c.missing, c.text))
            facts = {
                "non_null": F.count(shown), "nulls": F.count(F.when(c.missing, 1)), "min_length": F.min(size).cast("long"),
                "max_length": F.max(size).cast("long"), "sketch": F.hll_sketch_agg(shown, F.lit(SKETCH_BITS)),
            }
            aggregates += [fact.alias(f"{label}_{i}") for label, fact in facts.items()]
            known = [F.lit(c.name).alias("column"), F.lit(c.dtype.simpleString()).alias("data_type")]
            structs.append(F.struct(*known, *[F.col(f"{label}_{i}").alias(label) for label in facts]))
        rows = df.groupBy(part.alias("part")).agg(*aggregates).select("part", F.inline(F.array(*structs)))
        out = rows if out is None else out.unionByName(rows)
    return out


def merge_profiles(parts: DataFrame) -> DataFrame:
    """One row per column from the rows of ``profile_parts``; distinct values are estimated."""
    return parts.groupBy("column", "data_type").agg(
        F.sum("non_null").alias("non_null"), F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
        F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"),
    )


def column_issues(df: DataFrame) -> DataFrame:
    """(column, issue, count, total_records) for duplicates and nulls, only where there are any.

    Duplicates are the rows beyond the first of each value; nulls equal each other.
    """
    cells = values.cells(df)
    facts = {c.name: {"nulls": F.count(F.when(c.missing, 1))} for c in cells}
    nulls = _long(df, facts, {"total": F.count("*")})
    distinct = value_counts(df).groupBy("position").agg(F.count("*").alias("distinct_values"))
    both = nulls.join(distinct, "position", "left")
    seen = F.coalesce("distinct_values", F.lit(0)) + F.when(F.col("nulls") > 0, 1).otherwise(0)
    issues = F.array(
        F.struct(F.lit("Duplicate").alias("issue"), (F.col("total") - seen).cast("long").alias("count")),
        F.struct(F.lit("Null").alias("issue"), F.col("nulls").alias("count")),
    )
    return (
        both.select("column", F.inline(issues), F.col("total").alias("total_records"))
        .filter("count > 0")
        .select("column", "issue", "count", "total_records")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows: one row, ``duplicate_rows``."""
    keys = []
    for i, c in enumerate(values.cells(df)):
        keys.append((values.group_key(c.text) if c.is_text else c.value).alias(f"k{i}"))
    groups = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_issues(df: DataFrame) -> DataFrame:
    """(issue, column, amount): nulls above half, long text, numbers kept as text, duplicate rows."""
    none = F.lit(None)
    facts = {}
    for i, c in enumerate(values.cells(df)):
        here = ~c.missing
        facts[c.name] = {
            "nulls": F.count(F.when(c.missing, 1)),
            "longest": F.max(_length_name(i)) if c.is_text else Known(none.cast("int")),
            "numeric": (
                F.every(F.when(here, F.col(_number_name(i)).isNotNull())) if c.is_text else Known(none.cast("boolean"))
            ),
        }
    stats = _long(df, facts, {"total": F.count("*")})
    share = values.percent(F.col("nulls"), F.col("total"))
    found = F.array(
        F.when(share > 50, F.struct(F.lit("null_share").alias("issue"), share.alias("amount"))),
        F.when(F.col("longest") > 255, F.struct(F.lit("long_text").alias("issue"), F.col("longest").cast("double").alias("amount"))),
        F.when(
            F.coalesce("numeric", F.lit(False)),
            F.struct(F.lit("numeric_text").alias("issue"), (F.col("total") - F.col("nulls")).cast("double").alias("amount")),
        ),
    )
    by_column = stats.select("column", F.explode(F.array_compact(found)).alias("i")).select("i.issue", "column", "i.amount")
    copies = duplicate_rows(df).filter("duplicate_rows > 0").select(
        F.lit("duplicate_rows").alias("issue"),
        F.lit(None).cast("string").alias("column"),
        F.col("duplicate_rows").cast("double").alias("amount"),
    )
    return by_column.unionByName(copies)


def null_share(df: DataFrame) -> DataFrame:
    """Share of null cells in percent, one row."""
    cells = values.cells(df)
    nulls = sum((F.count(F.when(c.missing, 1)) for c in cells), F.lit(0))
    return df.agg(values.percent(nulls, F.count("*") * len(cells)).alias("null_percentage"))
