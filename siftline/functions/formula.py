"""Rule helper library: the functions a business rule may call, as Columns.

Names follow the rule language. Dates come from an explicit ``as_of`` so that
a rerun gives the same verdicts.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import values
from siftline.session import col


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def ISBLANK(c, trim: bool = False) -> Column:
    return values.blank(c, trim=trim)


def ISNULL(c) -> Column:
    return col(c).isNull()


def VALUE(c) -> Column:
    return values.number(c)


def TEXT(c) -> Column:
    return values.text(c)


def LEN(c) -> Column:
    return F.length(values.text(c))


def UPPER(c) -> Column:
    return F.upper(values.text(c))


def LOWER(c) -> Column:
    return F.lower(values.text(c))


def TRIM(c) -> Column:
    return values.strip(c)


def LEFT(c, n: int) -> Column:
    return F.left(values.text(c), _lit(n))


def RIGHT(c, n: int) -> Column:
    return F.right(values.text(c), _lit(n))


def MID(c, start: int, n: int) -> Column:
    """``n`` characters from the 1-based position ``start``."""
    return F.substring(values.text(c), start, n)


def FIND(search, c) -> Column:
    """1-based position of ``search`` in the text, 0 when absent or null."""
    return F.coalesce(F.locate(search, values.text(c)), F.lit(0))


def CONTAINS(c, search) -> Column:
    return F.coalesce(values.text(c).contains(search), F.lit(False))


def BEGINS(c, prefix) -> Column:
    return F.coalesce(values.text(c).startswith(prefix), F.lit(False))


def ENDS(c, suffix) -> Column:
    return F.coalesce(values.text(c).endswith(suffix), F.lit(False))


def TODAY(as_of: dt.date) -> Column:
    return F.lit(as_of).cast("date")


def NOW(as_of: dt.datetime) -> Column:
    return F.lit(as_of).cast("timestamp")


def YEAR(c) -> Column:
    return F.year(values.timestamp(c))


def MONTH(c) -> Column:
    return F.month(values.timestamp(c))


def DAY(c) -> Column:
    return F.dayofmonth(values.timestamp(c))


def AND(*conditions: Column) -> Column:
    return functools.reduce(operator.and_, conditions)


def OR(*conditions: Column) -> Column:
    return functools.reduce(operator.or_, conditions)


def NOT(condition: Column) -> Column:
    return ~condition


def IF(condition: Column, yes, no) -> Column:
    return F.when(condition, _lit(yes)).otherwise(_lit(no))


def CASE(c, pairs: list[tuple], default=None) -> Column:
    """Value of the first pair whose key equals ``c``."""
    subject = col(c)
    branches = functools.reduce(
        lambda chain, pair: chain.when(subject == _lit(pair[0]), _lit(pair[1])), pairs, F
    )
    return branches.otherwise(_lit(default))


def ABS(c) -> Column:
    return F.abs(col(c))


def ROUND(c, digits: int = 0) -> Column:
    """Half-even rounding."""
    return F.bround(col(c), digits)


def CEILING(c) -> Column:
    return F.ceil(col(c))


def FLOOR(c) -> Column:
    return F.floor(col(c))


def MAX(*cs) -> Column:
    return F.greatest(*[col(c) for c in cs])


def MIN(*cs) -> Column:
    return F.least(*[col(c) for c in cs])


def ISPICKVAL(c, value) -> Column:
    """Equality after trimming both sides; null counts as empty."""
    wanted = "" if value is None else str(value).strip()
    return F.coalesce(values.strip(c), F.lit("")) == wanted


def REGEX(c, pattern: str) -> Column:
    """Match anchored at the start of the text; null counts as empty."""
    return F.coalesce(values.text(c), F.lit("")).rlike(f"^(?:{pattern})")


_COMPARISONS = {
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
    "=": operator.eq,
    "==": operator.eq,
    "!=": operator.ne,
    "<>": operator.ne,
}


def LEN_COMPARE(c, comparison: str, threshold: int) -> Column:
    """``LEN(c) <comparison> threshold``; null counts as length 0."""
    return _COMPARISONS[comparison](F.length(F.coalesce(values.text(c), F.lit(""))), F.lit(threshold))
