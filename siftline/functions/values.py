"""Reading values: blanks, numbers, dates, booleans and their text form.

Everything is a built-in Column expression. ASCII rules are used for digits
and white space. ``try_`` variants keep ANSI mode from failing a job on one
bad cell.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import fixed
from siftline.session import col, sql_name, sql_text

WHITE = " \t\n\r\x0b\x0c"

#: Decimal and exponent forms, or the words for infinity and not-a-number.
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
#: The same without the words.
FINITE_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

#: Accepted date texts, tried in this order: shape, format, least and greatest length. The length of a
#: cell leaves few formats whose shape is tested, and the shape test keeps the parser from raising (and
#: swallowing) an exception for every other format.
DATE_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", 10, 10),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm", 16, 16),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss", 19, 19),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", 21, 26),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss", 19, 19),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "yyyy-MM-dd'T'HH:mm:ssX", 20, 20),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$", "yyyy-MM-dd'T'HH:mm:ss.SSSX", 24, 24),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", 27, 27),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d", 8, 10),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", 8, 10),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy", 8, 10),
    (r"^\d{8}$", "yyyyMMdd", 8, 8),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy", 10, 11),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", 11, 12),
]


def text(c: Column | str) -> Column:
    return col(c).cast("string")


def strip(c: Column | str) -> Column:
    """Text without leading and trailing white space (not only blanks)."""
    return F.trim(text(c), F.lit(WHITE))


def blank(c: Column | str, trim: bool = True) -> Column:
    """Null, or text that is empty (after trimming unless ``trim`` is off)."""
    value = strip(c) if trim else text(c)
    return col(c).isNull() | (value == "")


def number(c: Column | str) -> Column:
    """Text as a double; null when it is not a number."""
    value = strip(c)
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def timestamp(c: Column | str) -> Column:
    """Text as a timestamp by the first accepted format; null when none fits."""
    value = strip(c)
    size = F.octet_length(value)
    parsed = F.coalesce(
        *[
            F.when(size.between(least, most) & value.rlike(shape), F.try_to_timestamp(value, F.lit(fmt)))
            for shape, fmt, least, most in DATE_FORMATS
        ]
    )
    # No accepted form is longer, so long text is not tried at all.
    return F.when(size <= 32, parsed)


def stripped_timestamp(name: str) -> Column:
    """``timestamp`` of a named text column without outer white space."""
    c = sql_name(name)
    tries = ", ".join(
        f"CASE WHEN octet_length({c}) BETWEEN {least} AND {most} AND {c} RLIKE {sql_text(shape)} THEN try_to_timestamp({c}, {sql_text(fmt)}) END"
        for shape, fmt, least, most in DATE_FORMATS
    )
    start = sql_text(r"^(?:[0-9]|[A-Za-z]{3} [0-9])")
    return F.expr(f"CASE WHEN octet_length({c}) <= 32 AND {c} RLIKE {start} THEN coalesce({tries}) END")


def stripped_number(name: str) -> Column:
    """``number`` of a named text column without outer white space."""
    c = sql_name(name)
    return F.expr(f"CASE WHEN {c} RLIKE {sql_text(NUMBER)} THEN try_cast({c} AS DOUBLE) END")


def boolean(c: Column | str, short_tokens: bool = True) -> Column:
    """True / false / null by token; anything else is null."""
    value = F.lower(strip(c))
    yes = fixed.TRUE_TOKENS + (fixed.TRUE_TOKENS_SHORT if short_tokens else [])
    no = fixed.FALSE_TOKENS + (fixed.FALSE_TOKENS_SHORT if short_tokens else [])
    return F.when(value.isin(yes), F.lit(True)).when(value.isin(no), F.lit(False))


def contains_any(c: Column, words: list[str]) -> Column:
    """Does the (lower-case) text hold at least one of the words?"""
    return c.rlike("|".join(re.escape(w) for w in words))


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(text(c), F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def field_label(c: Column | str) -> Column:
    """API name to label: ``ns__Site_Code__c`` becomes ``Site Code``."""
    value = text(c)
    base = F.regexp_replace(value, r"__c$", "")
    last = F.element_at(F.split(base, "__"), -1)
    return F.when(value.endswith("__c"), title_case(F.replace(last, F.lit("_"), F.lit(" ")))).otherwise(
        title_case(value)
    )


def file_size_text(c: Column | str) -> Column:
    """Bytes as ``0 B``, ``12.0 B``, ``1.5 KB``, ``2.0 MB``, ``3.1 GB``."""
    size = col(c).cast("double")

    def in_unit(power: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround(size / F.lit(1024.0**power), 1))

    return (
        F.when(size == 0, F.lit("0 B"))
        .when(size < 1024.0, in_unit(0, "B"))
        .when(size < 1024.0**2, in_unit(1, "KB"))
        .when(size < 1024.0**3, in_unit(2, "MB"))
        .otherwise(in_unit(3, "GB"))
    )


def band(score: Column, levels: list[tuple[float, str]], lowest: str) -> Column:
    """Name of the first level whose threshold the score reaches."""
    result = F.lit(lowest)
    for threshold, name in reversed(levels):
        result = F.when(score >= threshold, F.lit(name)).otherwise(result)
    return result


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 for an empty whole."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def group_key(c: Column | str) -> Column:
    """Equality key of bounded size: long texts are replaced by their SHA-256.

    A digest form is longer than any text kept as it is, so the two never meet.
    """
    value = text(c)
    return F.when(F.octet_length(value) <= 64, value).otherwise(F.concat(F.lit("sha256:"), F.sha2(value, 256)))


@dataclass(frozen=True)
class Cell:
    """One column of a frame together with its type, for type-aware checks.

    ``stripped_as``, ``number_as`` and ``date_as`` name columns that already
    hold the stripped text, the parsed number and the parsed date (see
    ``prepared_cells``); without them the expressions are written out at each use.
    """

    name: str
    dtype: T.DataType
    stripped_as: str | None = None
    number_as: str | None = None
    date_as: str | None = None

    @property
    def value(self) -> Column:
        return F.col(f"`{self.name}`")

    @property
    def text(self) -> Column:
        return self.value.cast("string")

    @property
    def stripped(self) -> Column:
        if self.stripped_as:
            return F.col(self.stripped_as)
        return strip(self.value) if self.is_text else self.text

    @property
    def is_text(self) -> bool:
        return isinstance(self.dtype, (T.StringType, T.CharType, T.VarcharType))

    @property
    def is_whole(self) -> bool:
        return isinstance(self.dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

    @property
    def is_fractional(self) -> bool:
        return isinstance(self.dtype, (T.FloatType, T.DoubleType))

    @property
    def is_numeric(self) -> bool:
        return self.is_whole or self.is_fractional or isinstance(self.dtype, T.DecimalType)

    @property
    def is_date(self) -> bool:
        return isinstance(self.dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))

    @property
    def is_boolean(self) -> bool:
        return isinstance(self.dtype, T.BooleanType)

    @property
    def missing(self) -> Column:
        """Null; for floating columns NaN as well."""
        return self.value.isNull() | F.isnan(self.value) if self.is_fractional else self.value.isNull()

    @property
    def blank(self) -> Column:
        return self.value.isNull() | (self.stripped == "") if self.is_text else self.missing

    @property
    def number(self) -> Column:
        if self.number_as:
            return F.col(self.number_as)
        if self.is_numeric:
            return self.value.cast("double")
        if self.is_boolean:
            return self.value.cast("int").cast("double")
        return number(self.value)

    @property
    def date(self) -> Column:
        if self.date_as:
            return F.col(self.date_as)
        return self.value.cast("timestamp") if self.is_date else timestamp(self.text)


def cell(df: DataFrame, name: str) -> Cell:
    return Cell(name, df.schema[name].dataType)


def cells(df: DataFrame, names: list[str] | None = None) -> list[Cell]:
    return [cell(df, n) for n in (names or df.columns)]


def prepared_cells(
    df: DataFrame, names: list[str], numbers: set[str] | None = None, dates: set[str] | None = None
) -> tuple[DataFrame, dict[str, Cell]]:
    """Frame with stripped text, number and date of text columns, and its cells.

    Several checks of one cell then share them: without this each check would
    strip and parse again. ``numbers`` and ``dates`` name the columns to parse
    (all when omitted).
    """
    plain = {n: cell(df, n) for n in names}
    ids = {n: i for i, n in enumerate(n for n, c in plain.items() if c.is_text)}
    df = df.select("*", *[strip(plain[n].value).alias(f"_stripped_{i}") for n, i in ids.items()])
    parsed, out = [], {}
    for n, c in plain.items():
        if n not in ids:
            out[n] = c
            continue
        i = ids[n]
        number_as = f"_number_{i}" if numbers is None or n in numbers else None
        date_as = f"_date_{i}" if dates is None or n in dates else None
        if number_as:
            parsed.append(stripped_number(f"_stripped_{i}").alias(number_as))
        if date_as:
            parsed.append(stripped_timestamp(f"_stripped_{i}").alias(date_as))
        out[n] = Cell(n, c.dtype, f"_stripped_{i}", number_as, date_as)
    return (df.select("*", *parsed) if parsed else df), out
