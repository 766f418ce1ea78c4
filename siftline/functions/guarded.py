"""Predicates whose run-time errors become a flag of the row instead of the end of the job.

Under ANSI a cast, a division, an element access or a date that cannot be read raises. The predicate
is analysed by Spark, and its tree is written out again as SQL twice: as a value in which every
such step has its ``try_`` form, and as a condition that is true where a step got its inputs and
gave nothing. What AND, OR, CASE, IF and COALESCE do not evaluate does not count.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame

_TRY = {"Divide": "try_divide", "Remainder": "try_mod", "Add": "try_add", "Subtract": "try_subtract", "Multiply": "try_multiply"}
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_FLOATING = ("float", "double")


def _any(parts: list[str | None]) -> str | None:
    found = [p for p in parts if p]
    return "(" + " OR ".join(found) + ")" if found else None


def _all(parts: list[str | None]) -> str:
    return "(" + " AND ".join(p for p in parts if p) + ")"


def _splice(node, before: list[str], after: list[str]) -> str | None:
    """The node's text with its children's texts replaced, in order; None where they cannot be found."""
    text = node.sql()
    name = node.prettyName() + "("
    at = len(name) if text.startswith(name) else 0
    out = text[:at]
    for old, new in zip(before, after, strict=True):
        start = at
        while True:
            start = text.find(old, start)
            if start < 0:
                return None
            end = start + len(old)
            around = text[start - 1 : start] + "|" + text[end : end + 1]
            if not re.search(r"[\w`']\||\|[\w`']", around) or not re.match(r"[\w`']", old):
                break
            start = end
        out += text[at:start] + new
        at = end
    return out + text[at:]


def _arguments(node) -> list:
    """The node's children; for a function that Spark replaces by other expressions, what it was called with."""
    found = node.children()
    if found.size() == 1:
        try:
            found = node.parameters()
        except Py4JError:  # not such a function
            pass
    return [found.apply(i) for i in range(found.size())]


class _Writer:
    """Writes an analysed expression as (value, raised): SQL texts; ``raised`` is None where nothing can."""

    def __init__(self, spark):
        self.spark = spark
        self.known: dict[str, bool] = {}

    def _has_function(self, name: str) -> bool:
        if name not in self.known:
            self.known[name] = self.spark.catalog.functionExists(name)
        return self.known[name]

    def write(self, node) -> tuple[str, str | None]:
        kind = node.getClass().getSimpleName()
        children = _arguments(node)
        if kind == "Alias":
            return self.write(children[0])
        if kind == "AttributeReference":
            return "`" + node.name().replace("`", "``") + "`", None
        if not children or any(c.getClass().getSimpleName() == "LambdaFunction" for c in children):
            return node.sql(), None  # what a lambda raises stays as it is
        parts = [self.write(c) for c in children]
        values, raised = [v for v, _ in parts], [r for _, r in parts]
        lazy = self._lazy(kind, values, raised)
        plain = _splice(node, [c.sql() for c in children], values)
        if plain is None:
            return node.sql(), None
        if lazy is not None:
            return plain, lazy[0]
        value, own = self._raising(node, kind, children, values, plain)
        return value, _any([*raised, own])

    @staticmethod
    def _lazy(kind: str, values: list[str], raised: list[str | None]) -> tuple[str | None] | None:
        """What raises of the parts that are evaluated, for expressions that do not evaluate all of them."""
        if kind in ("And", "Or"):
            stops = f"coalesce({values[0]}, {'true' if kind == 'And' else 'false'})"
            second = raised[1] and _all([stops if kind == "And" else f"NOT {stops}", raised[1]])
            return (_any([raised[0], second]),)
        if kind in ("CaseWhen", "If"):
            found, open_ = [], []
            for i in range(0, len(values) - 1, 2):
                hit = f"coalesce({values[i]}, false)"
                found.append(raised[i] and _all([*open_, raised[i]]))
                found.append(raised[i + 1] and _all([*open_, hit, raised[i + 1]]))
                open_ = [*open_, f"NOT {hit}"]
            if len(values) % 2:
                found.append(raised[-1] and _all([*open_, raised[-1]]))
            return (_any(found),)
        if kind in ("Coalesce", "Nvl"):
            missing = [f"{v} IS NULL" for v in values]
            return (_any([r and _all([*missing[:i], r]) for i, r in enumerate(raised)]),)
        return None

    def _raising(self, node, kind: str, children: list, values: list[str], plain: str) -> tuple[str, str | None]:
        """(text that gives null in place of an error, condition for the error) of one step."""
        present = [f"{v} IS NOT NULL" for v in values]
        result = node.dataType().sql().lower()

        def lost(value: str) -> tuple[str, str]:
            return value, _all([*present, f"{value} IS NULL"])

        if kind == "Cast":
            source = children[0].dataType().sql().lower()
            if node.evalMode().toString() != "ANSI" or result == "string" or source == result or result in _FLOATING and source != "string":
                return plain, None
            if source in _WHOLE and result in _WHOLE and _WHOLE.index(source) <= _WHOLE.index(result) or (source, result) == ("date", "timestamp"):
                return plain, None
            return lost(f"TRY_CAST({values[0]} AS {node.dataType().sql()})")
        if kind in ("IntegralDivide", "Pmod"):
            zero = f"{values[1]} = 0"
            return f"(CASE WHEN NOT {zero} THEN {plain} END)", _all([present[0], zero])
        if kind in _TRY:
            if kind not in ("Divide", "Remainder") and result not in _WHOLE and not result.startswith("decimal"):
                return plain, None
            if getattr(node, "evalMode", None) is not None and node.evalMode().toString() == "TRY":
                return plain, None
            return lost(f"{_TRY[kind]}({', '.join(values)})")
        if kind == "UnaryMinus" and result in _WHOLE:
            return lost(f"try_subtract(CAST(0 AS {result}), {values[0]})")
        if kind in ("ElementAt", "GetArrayItem"):
            if children[0].dataType().typeName() != "array":
                return plain, None  # a key that a map lacks gives null
            array, place = values
            if kind == "GetArrayItem":
                return f"get({array}, {place})", _all([*present, f"({place} < 0 OR {place} >= size({array}))"])
            if plain.startswith("try_"):
                return plain, None
            return f"(CASE WHEN {place} <> 0 THEN try_element_at({array}, {place}) END)", _all([*present, f"({place} = 0 OR abs({place}) > size({array}))"])
        name = node.prettyName()
        if plain.startswith(name + "(") and not name.startswith("try_") and self._has_function(f"try_{name}"):
            return lost("try_" + plain)
        return plain, None


def guarded(empty: DataFrame, predicates: list[str]) -> list[tuple[str, str | None]]:
    """(value, raised) of predicates over the columns of ``empty``, as SQL texts; one analysis for all.

    ``raised`` is None when no step of the predicate can raise; the value is then the predicate.
    Steps without a ``try_`` form, and those inside lambda functions, raise as before.
    """
    if not predicates:
        return []
    plan = empty.selectExpr(*[f"({p}) AS p{i}" for i, p in enumerate(predicates)])._jdf.queryExecution().analyzed()
    if plan.nodeName() != "Project":  # an aggregate or a generator is no condition on a row
        return [(p, None) for p in predicates]
    writer = _Writer(empty.sparkSession)
    written = [writer.write(plan.expressions().apply(i)) for i in range(len(predicates))]
    return [(p, None) if raised is None else (value, raised) for p, (value, raised) in zip(predicates, written, strict=True)]
