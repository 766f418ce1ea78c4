"""Business rules: predicate rules and rules known only by their message."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline import session
from siftline.functions import fixed, formula, guarded, values
from siftline.operators import checks, constraints

#: Up to this many rules are compiled into one projection; more are evaluated as arrays. Results are equal.
INLINE_RULES = 200
#: A table with more predicate rules is refused: they all become part of one plan.
MOST_RULES = 20_000
CATEGORY = "Business Rule Errors"


# --- predicate rules ------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``predicate`` is the error condition: where it is true, the row is invalid."""

    name: str
    predicate: Column | str
    message: str = ""
    active: bool = True
    fields: tuple[str, ...] = field(default=())


def rules_from_table(rules: DataFrame) -> list[Rule]:
    """Rules from (rule_name, predicate[, message, field, active]) rows.

    Active is true / 1 / yes. A rule without predicate tests its first field
    for blank.
    """
    def optional(name: str) -> Column:
        return (F.col(name).cast("string") if name in rules.columns else F.lit(None).cast("string")).alias(name)

    # Predicates become part of the plan, so all of them come to the driver.
    named = rules.select(*[optional(n) for n in ("rule_name", "predicate", "message", "field", "active")])
    rows = session.bounded_collect(named, MOST_RULES, "rules")
    out = []
    for i, r in enumerate(rows):
        names = [f.strip() for f in (r["field"] or "").split(",") if f.strip()] or ["Id"]
        text = (r["predicate"] or "").strip()
        predicate = text if text and text.lower() != "nan" else formula.ISBLANK(F.col(f"`{names[0]}`"))
        name = (r["rule_name"] or "").strip() or f"Rule_{i + 1}"
        active = r["active"] is None or r["active"].strip().lower() in ("true", "1", "yes")
        out.append(Rule(name, predicate, r["message"] or "", active, tuple(names) if r["field"] else ()))
    return out


def with_unique_names(rules: list[Rule]) -> list[Rule]:
    """Repeated names get a running suffix: ``name``, ``name_1``, ``name_2``."""
    seen: set[str] = set()
    out = []
    for r in rules:
        name, n = r.name, 0
        while name in seen:
            n += 1
            name = f"{r.name}_{n}"
        seen.add(name)
        out.append(Rule(name, r.predicate, r.message, r.active, r.fields))
    return out


def _unusable(empty: DataFrame, conditions: list[Column]) -> set[int]:
    """Places of the conditions that cannot be parsed or analysed: halves are tried, not each alone."""
    if not conditions:
        return set()
    try:
        empty.select(*[c.cast("boolean").alias(f"c{i}") for i, c in enumerate(conditions)])
        return set()
    except AnalysisException:  # a ParseException is one, too
        if len(conditions) == 1:
            return {0}
    half = len(conditions) // 2
    return _unusable(empty, conditions[:half]) | {half + i for i in _unusable(empty, conditions[half:])}


def formulas_failed(df: DataFrame, rules: list[Rule]) -> list[Column]:
    """For each rule, true where the row breaks it.

    A rule on a column the frame lacks, and one whose predicate cannot be parsed or analysed, fails
    every row. A row on which a predicate in text form would raise (a cast, a division, an element or a
    date that cannot be read) breaks the rule; a null condition is no error. All rules are analysed
    together, against an empty frame with the columns of ``df``.
    """
    empty = df.sparkSession.createDataFrame([], df.schema)
    out: list[Column] = [F.lit(True)] * len(rules)
    columns = set(df.columns)
    usable = [i for i, r in enumerate(rules) if columns.issuperset(r.fields)]
    conditions = [F.expr(p) if isinstance(p := rules[i].predicate, str) else p for i in usable]
    bad = _unusable(empty, conditions)
    good = [(i, c) for j, (i, c) in enumerate(zip(usable, conditions, strict=True)) if j not in bad]
    texts = [i for i, _ in good if isinstance(rules[i].predicate, str)]
    safe = dict(zip(texts, guarded.guarded(empty, [rules[i].predicate for i in texts]), strict=True))
    for i, condition in good:
        value, raised = safe.get(i, (None, None))
        if raised is not None:
            out[i] = F.coalesce(F.expr(raised), F.lit(False)) | F.coalesce(F.expr(value).cast("boolean"), F.lit(False))
        else:
            out[i] = F.coalesce(condition.cast("boolean"), F.lit(False))
    return out


def formula_failed(df: DataFrame, rule: Rule) -> Column:
    """True where the row breaks the rule; see ``formulas_failed``."""
    return formulas_failed(df, [rule])[0]


def validate_frame(df: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """All active rules: adds ``violations``, ``error_count`` and ``is_valid``."""
    listed = rules_from_table(rules) if isinstance(rules, DataFrame) else rules
    active = [r for r in with_unique_names(listed) if r.active]
    found = [
        checks.Check(r.name, ",".join(r.fields), CATEGORY, failed, F.lit(r.message or r.name))
        for r, failed in zip(active, formulas_failed(df, active), strict=True)
    ]
    return checks.with_violations(df, found)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows)."""
    return checked.filter("is_valid"), checked.filter(~F.col("is_valid"))


def run_summary(checked: DataFrame) -> DataFrame:
    """Total, valid, invalid and valid share of a checked frame, one row."""
    valid = F.count_if(F.col("is_valid"))
    total = F.count("*")
    return checked.agg(
        total.alias("total_records"),
        valid.alias("valid_records"),
        (total - valid).alias("invalid_records"),
        values.percent(valid, total).alias("success_rate"),
    )


def attach_results(df: DataFrame, verdicts: DataFrame, row_id: str) -> DataFrame:
    """Left-join verdicts (row_id, is_valid, errors array) on the row key.

    A row without a verdict is invalid; errors become ``; ``-joined text.
    """
    slim = verdicts.select(
        F.col("row_id").alias("_rid"), F.col("is_valid").alias("_ok"), F.array_join("errors", "; ").alias("_errors")
    )
    joined = df.join(slim, F.col(row_id) == F.col("_rid"), "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    return joined.select(
        *df.columns,
        ok.alias("is_valid"),
        F.when(ok, F.lit("")).otherwise(F.coalesce(F.col("_errors"), F.lit(""))).alias("validation_errors"),
    )


def rule_applicability(rules: DataFrame) -> DataFrame:
    """Active rules with and without field mapping; those without are skipped."""
    mapped = F.coalesce(F.size("mappings") > 0, F.lit(False))
    active = F.coalesce(F.col("active"), F.lit(True))
    return rules.agg(
        F.count("*").alias("total_rules"),
        F.count_if(active).alias("active_rules"),
        F.count_if(active & mapped).alias("rules_applied"),
        F.count_if(active & ~mapped).alias("rules_skipped"),
    )


def rule_fields(text: Column | str) -> Column:
    """Identifiers in rule text, without function words and numbers."""
    names = F.regexp_extract_all(session.col(text), F.lit(fixed.IDENTIFIER), F.lit(1))
    kept = F.filter(names, lambda n: ~n.rlike("^[0-9]+$"))
    return F.array_except(kept, F.array(*[F.lit(w) for w in fixed.FUNCTION_WORDS]))


# --- message rules: which column ---------------------------------------------------------


def _rule_text() -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("rule_name", "error_message", "description")]
    return F.lower(F.concat_ws(" ", *parts))


def resolve_rule_field(rules: DataFrame) -> DataFrame:
    """Adds ``target_field`` and ``source_column`` to message rules.

    The rule's own field goes first when it is mapped; then a mapped field of
    the kind the text speaks of; then a mapped field that shares words with a
    field mentioned in the message. Null when none fits.
    """
    text = _rule_text()
    entries = F.map_entries("mappings")
    own = F.when(F.col("error_field") != "", F.col("error_field"))
    direct = F.when(F.array_contains(F.map_keys("mappings"), own), own)

    kinds = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, ws in fixed.FIELD_KIND_WORDS for w in ws]
    )

    def of_kind(pair: Column) -> Column:
        return F.filter(
            entries, lambda e: F.lower(e["key"]).contains(pair["k"]) | F.lower(e["key"]).contains(pair["w"])
        )

    by_kind = F.get(
        F.flatten(F.transform(F.filter(kinds, lambda p: text.contains(p["w"])), of_kind)), F.lit(0)
    )["key"]

    patterns = fixed.FIELD_MENTIONS[:9] + fixed.FIELD_MENTIONS_RESOLVE
    plain = list(rules.columns)
    rules = rules.withColumn("_message", F.coalesce(F.col("error_message"), F.lit("")))
    candidates = constraints.mentions(constraints.Text("_message"), patterns)

    def shares_words(candidate: Column) -> Column:
        c = F.lower(candidate)

        def fits(e: Column) -> Column:
            t = F.lower(e["key"])
            return (
                t.contains(c)
                | c.contains(t)
                | F.exists(F.split(c, r"\s+"), lambda w: t.contains(w))
                | F.exists(F.split(t, r"\s+"), lambda w: c.contains(w))
            )

        return F.filter(entries, fits)

    by_mention = F.get(F.flatten(F.transform(candidates, shares_words)), F.lit(0))["key"]
    has_mapping = F.coalesce(F.size("mappings") > 0, F.lit(False))
    target = F.when(has_mapping, F.coalesce(direct, by_kind, by_mention))
    source = F.when(F.col("target_field").isNotNull(), F.try_element_at("mappings", F.col("target_field")))
    return rules.withColumn("target_field", target).select(*plain, "target_field", source.alias("source_column"))


# --- message rules: which check ------------------------------------------------------------

PLAN_COLUMNS = [
    "rule_name", "error_message", "text", "source_column", "kind", "fails_blank", "min_value", "max_value",
    "min_length", "max_length", "exact_length", "allowed_values",
]


def message_rule_plan(rules: DataFrame) -> DataFrame:
    """Active rules with the column they test and the kind of test.

    Kinds in order of precedence: length, range, minimum, maximum, allowed,
    email, phone, required, date, number, length_text, format_text, unique,
    business, critical, none; ``unmapped`` and ``unresolved`` rules have no
    column.
    """
    listed = rules.filter(F.coalesce(F.col("active"), F.lit(True))).withColumn("text", _rule_text())
    listed = listed.withColumn("error_message", F.coalesce(F.col("error_message"), F.lit("")))
    found = constraints.extract_constraints(resolve_rule_field(listed), "error_message", with_units=True)
    t = F.col("text")

    def says(words: list[str]) -> Column:
        return values.contains_any(t, words)

    types = F.col("constraint_types")
    by_value = (
        F.when(F.arrays_overlap(types, F.array(*[F.lit(x) for x in ("min_length", "max_length", "length_range", "exact_length")])), "length")
        .when(F.array_contains(types, "range"), "range")
        .when(F.array_contains(types, "minimum"), "minimum")
        .when(F.array_contains(types, "maximum"), "maximum")
        .when(F.col("allowed_values").isNotNull(), "allowed")
    )
    needs_value = says(fixed.REQUIRED_WORDS)
    by_words = (
        F.when(says(fixed.EMAIL_WORDS), "email")
        .when(says(fixed.PHONE_WORDS), "phone")
        .when(needs_value & ~says(fixed.ALSO_FORMAT_WORDS), "required")
        .when(says(fixed.DATE_WORDS), "date")
        .when(says(fixed.NUMBER_WORDS), "number")
        .when(says(fixed.LENGTH_WORDS), "length_text")
        .when(says(fixed.FORMAT_WORDS), "format_text")
        .when(says(fixed.UNIQUE_WORDS), "unique")
        .when(says(fixed.BUSINESS_WORDS), "business")
        .when(says(fixed.CRITICAL_WORDS), "critical")
        .otherwise("none")
    )
    kind = (
        F.when(~F.coalesce(F.size("mappings") > 0, F.lit(False)), "unmapped")
        .when(
            F.col("source_column").isNull(),
            F.when(says(fixed.UNRESOLVED_FAILS_WORDS), "unresolved_fails").otherwise("unresolved_passes"),
        )
        .otherwise(F.coalesce(by_value, by_words))
    )
    planned = found.withColumn("kind", kind)
    fails_blank = (
        F.when(F.col("kind").isin("email", "phone"), says(fixed.BLANK_FAILS_WORDS))
        .when(
            F.col("kind").isin("required", "date", "number", "length_text", "format_text", "unique", "business", "critical", "none"),
            needs_value,
        )
        .otherwise(F.lit(False))
    )
    return planned.withColumn("fails_blank", fails_blank).select(*PLAN_COLUMNS)


# --- message rules: contexts -----------------------------------------------------------------


def date_context(value: Column, text: Column, as_of: dt.date, parsed: Column | None = None) -> Column:
    """A date; before or after ``as_of`` when the text says so. Blank passes."""
    day = (values.timestamp(value) if parsed is None else parsed).cast("date")
    today = F.lit(as_of).cast("date")
    judged = (
        F.when(values.contains_any(text, fixed.FUTURE_WORDS), day > today)
        .when(values.contains_any(text, fixed.PAST_WORDS), day < today)
        .otherwise(day.isNotNull())
    )
    return values.blank(value) | F.coalesce(judged, F.lit(False))


def number_context(value: Column, text: Column, parsed: Column | None = None) -> Column:
    """A number; positive, negative or whole when the text says so. Blank passes."""
    n = values.number(value) if parsed is None else parsed
    whole = ~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))) & (n == F.floor(n))
    above_zero = ~F.isnan(n) & (n > 0)
    judged = (
        F.when(text.contains("positive number"), above_zero)
        .when(text.contains("negative number"), n < 0)
        .when(text.contains("greater than zero"), above_zero)
        .when(text.contains("integer"), whole)
        .otherwise(n.isNotNull())
    )
    return values.blank(value) | F.coalesce(judged, F.lit(False))


_EXACT_LENGTH = r"(?:exactly|must be)\s+(\d+)\s+characters?"
_LOW_LENGTH = r"(?:minimum|min|at least)\s+(\d+)"
_HIGH_LENGTH = r"(?:maximum|max|no more than|up to)\s+(\d+)"


def _named_length(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("long")


def length_context(value: Column, text: Column) -> Column:
    """Exact, minimum and maximum length named in the text; null has length 0."""
    size = F.length(F.coalesce(values.text(value), F.lit("")))
    exact, low, high = (_named_length(text, p) for p in (_EXACT_LENGTH, _LOW_LENGTH, _HIGH_LENGTH))
    spans = (
        F.coalesce(size >= low, F.lit(True))
        & F.coalesce(size <= high, F.lit(True))
        & ~(text.contains("too long") & (size > fixed.TOO_LONG))
        & ~(~text.contains("too long") & text.contains("too short") & (size < 1))
    )
    return F.when(exact.isNotNull(), size == exact).otherwise(spans)


def format_context(value: Column, text: Column) -> Column:
    """Alphabet, letter case or US zip form named in the text; null is empty."""
    v = F.coalesce(values.text(value), F.lit(""))
    return (
        F.when(text.contains("alphanumeric"), v.rlike(r"^[a-zA-Z0-9]*$"))
        .when(text.contains("no special characters"), v.rlike(r"^[a-zA-Z0-9\s]*$"))
        .when(text.contains("uppercase"), (F.upper(v) == v) & (F.lower(v) != v))
        .when(text.contains("lowercase"), (F.lower(v) == v) & (F.upper(v) != v))
        .when(text.contains("zip code") | text.contains("postal code"), v.rlike(r"^[0-9]{5}(-[0-9]{4})?$"))
        .otherwise(F.lit(True))
    )


def status_or_stage(value: Column, text: Column) -> Column:
    """Listed status or stage values when the text names one; else not blank."""
    v = F.lower(values.text(value))
    return (
        F.when(text.contains("status") & value.isNotNull(), v.isin(fixed.STATUS_VALUES))
        .when(~text.contains("status") & text.contains("stage") & value.isNotNull(), v.isin(fixed.STAGE_VALUES))
        .otherwise(~values.blank(value))
    )


def loose_phone(value: Column) -> Column:
    """At least ten digits; blank passes."""
    return values.blank(value) | (F.length(F.regexp_replace(values.text(value), "[^0-9]", "")) >= 10)


def loose_email(value: Column) -> Column:
    return values.blank(value) | values.text(value).rlike(fixed.EMAIL)


def not_null(value: Column) -> Column:
    return ~values.blank(value)


# --- message rules: evaluation ------------------------------------------------------------------


@dataclass(frozen=True)
class Parsed:
    """A cell with its number and date, parsed once for all rules."""

    value: Column
    number: Column
    date: Column

    @property
    def empty(self) -> Column:
        return values.blank(self.value)

    @property
    def size(self) -> Column:
        return F.length(F.coalesce(values.text(self.value), F.lit("")))


def _tests(c: Parsed, p: Callable[[str], Column], as_of: dt.date) -> dict[str, Callable[[], Column]]:
    """The test of each kind of planned rule; ``p`` gives the plan's columns."""

    def within() -> Column:
        n = c.number
        fits = F.coalesce(n >= p("min_value"), F.lit(True)) & F.coalesce(n <= p("max_value"), F.lit(True))
        return c.empty | (n.isNotNull() & ~F.isnan(n) & fits)

    def length() -> Column:
        return (
            F.coalesce(c.size >= p("min_length"), F.lit(True))
            & F.coalesce(c.size <= p("max_length"), F.lit(True))
            & F.coalesce(c.size == p("exact_length"), F.lit(True))
        )

    return {
        "length": length,
        "range": within,
        "minimum": within,
        "maximum": within,
        "allowed": lambda: F.array_contains(p("allowed_values"), F.coalesce(values.strip(c.value), F.lit(""))),
        "email": lambda: loose_email(c.value),
        "phone": lambda: loose_phone(c.value),
        "date": lambda: date_context(c.value, p("text"), as_of, c.date),
        "number": lambda: number_context(c.value, p("text"), c.number),
        "length_text": lambda: length_context(c.value, p("text")),
        "format_text": lambda: format_context(c.value, p("text")),
        "business": lambda: ~c.empty,
        "critical": lambda: ~c.empty,
        "unresolved_fails": lambda: F.lit(False),
    }


def message_passes(kind: str | Column, c: Parsed, p: Callable[[str], Column], as_of: dt.date) -> Column:
    """Verdict of one cell on one planned rule.

    A rule that is part of the plan has a known kind and gives just its test;
    rules joined to cells choose by their kind column.
    """
    tests = _tests(c, p, as_of)
    if isinstance(kind, str):
        passed = tests[kind]() if kind in tests else F.lit(True)
    else:
        chain = F
        for name, test in tests.items():
            chain = chain.when(kind == name, test())
        passed = chain.otherwise(F.lit(True))
    return ~(p("fails_blank") & c.empty) & F.coalesce(passed, F.lit(True))


def message_rule_check(
    df: DataFrame, rules: DataFrame, row_id: str, as_of: dt.date, inline_rules: int = INLINE_RULES
) -> DataFrame:
    """Message rules on a frame: adds ``violations``, ``error_count``, ``is_valid``.

    Violations are in the order of the rules. Few rules are compiled into the
    projection, many are arrays that it evaluates; neither moves a row, and the
    results are equal. ``row_id`` is not needed for it; a rule may test that column.
    """
    plan = session.stage(message_rule_plan(rules).withColumn("position", F.monotonically_increasing_id()), "rule-plan")
    if plan.count() <= inline_rules:
        listed = sorted(plan.collect(), key=lambda r: r["position"])
        used = [c for c in df.columns if c in {r["source_column"] for r in listed}]
        ready, cells = values.prepared_cells(
            df,
            used,
            numbers={r["source_column"] for r in listed if r["kind"] in ("range", "minimum", "maximum", "number")},
            dates={r["source_column"] for r in listed if r["kind"] == "date"},
        )
        judged = checks.with_violations(ready, [_inline_check(cells, r, as_of) for r in listed])
        return judged.select(*[F.col(f"`{c}`") for c in df.columns], "violations", "error_count", "is_valid")
    return _by_arrays(df, plan, as_of)


_PLAN_TYPES = {
    "fails_blank": "boolean", "min_value": "double", "max_value": "double", "min_length": "long", "max_length": "long",
    "exact_length": "long", "text": "string",
}


def _inline_check(cells: dict[str, values.Cell], r, as_of: dt.date) -> checks.Check:
    kind, c = r["kind"], cells.get(r["source_column"])
    if r["source_column"] is not None and c is None:
        kind = "unresolved_fails" if any(w in r["text"] for w in fixed.UNRESOLVED_FAILS_WORDS) else "unresolved_passes"

    def literal(name: str) -> Column:
        if name == "allowed_values":
            return F.array(*[F.lit(v) for v in r[name] or []]).cast("array<string>")
        return F.lit(r[name]).cast(_PLAN_TYPES[name])

    if c is None:
        passed = F.lit(kind != "unresolved_fails")
    else:
        passed = message_passes(kind, Parsed(c.value, c.number, c.date), literal, as_of)
    message = F.lit(r["error_message"] or f"Validation failed for {r['rule_name']}")
    return checks.Check(r["rule_name"], c.name if c else "", CATEGORY, ~passed, message)


def _said(text: Column) -> dict[str, Column]:
    """What the contexts read of a text, as a text on which they judge alike, by kind."""

    def first(words: list[str]) -> Column:
        chain = F
        for word in words:
            chain = chain.when(text.contains(word), word)
        return chain.otherwise("")

    def length(pattern: str, said: str) -> Column:
        return F.format_string(said, F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))

    # Without a number the text is null and left out.
    spans = [(_EXACT_LENGTH, "exactly %s characters"), (_LOW_LENGTH, "minimum %s"), (_HIGH_LENGTH, "maximum %s")]
    return {
        "date": F.when(values.contains_any(text, fixed.FUTURE_WORDS), fixed.FUTURE_WORDS[0])
        .when(values.contains_any(text, fixed.PAST_WORDS), fixed.PAST_WORDS[0]).otherwise(""),
        "number": first(["positive number", "negative number", "greater than zero", "integer"]),
        "length_text": F.concat_ws(
            " ", *[F.when(F.regexp_extract(text, p, 1) != "", length(p, said)) for p, said in spans],
            *[F.when(text.contains(w), w) for w in ("too long", "too short")],
        ),
        "format_text": first(["alphanumeric", "no special characters", "uppercase", "lowercase", "zip code", "postal code"]),
    }


def _parameters() -> dict[str, Column]:
    """What the test of a planned rule depends on: rules that agree in it pass and fail together."""
    kind = F.col("kind")
    read = {
        "min_value": ("range", "minimum", "maximum"), "max_value": ("range", "minimum", "maximum"),
        "min_length": ("length",), "max_length": ("length",), "exact_length": ("length",), "allowed_values": ("allowed",),
    }
    text = F
    for name, said in _said(F.col("text")).items():
        text = text.when(kind == name, said)
    return {"kind": kind, "fails_blank": F.col("fails_blank"), "text": text, **{n: F.when(kind.isin(*kinds), F.col(n)) for n, kinds in read.items()}}


def _at_places(items: Column, broken: str) -> Column:
    return F.transform(broken, lambda r: F.get(items, r["place"]))


def _by_arrays(df: DataFrame, plan: DataFrame, as_of: dt.date) -> DataFrame:
    """The distinct tests of each column as one array of structs, evaluated in the row.

    No cell is multiplied and no row is moved. Rules that ask the same of a column are one test with their number,
    so the count of a row needs no list of rules; the lists are made for a consumer of ``violations`` alone, in
    the row up to ``BROADCAST_BYTES`` of them, else by joining the tests that rows break to their rules.
    """
    known = F.col("source_column").isin(df.columns)
    used = [r["source_column"] for r in plan.filter(known).select("source_column").distinct().collect()]
    used = [c for c in df.columns if c in used]
    fails = F.when(F.col("source_column").isNull(), F.col("kind") == "unresolved_fails").otherwise(
        values.contains_any(F.col("text"), fixed.UNRESOLVED_FAILS_WORDS)
    )
    message = F.when(F.col("error_message") != "", F.col("error_message")).otherwise(F.concat(F.lit("Validation failed for "), "rule_name"))
    violation = F.struct(
        F.col("rule_name").alias("rule"), F.coalesce("column", F.lit("")).alias("field"), F.lit(CATEGORY).alias("category"),
        F.lit("error").alias("severity"), message.alias("message"),
    )
    asked = plan.withColumn("column", F.when(known, F.col("source_column"))).filter(F.col("column").isNotNull() | fails)
    # Rules without a column that every row breaks are one test without parameters.
    key = ["column", *[F.when(F.col("column").isNotNull(), c).alias(n) for n, c in _parameters().items()]]
    ruled = asked.select(*key, F.struct("position", violation.alias("v")).alias("rule"))
    names = ["column", *_parameters()]
    tests = session.stage(ruled.groupBy(*names).agg(F.count("*").alias("n"), F.min("rule.position").alias("test")), "rule-tests")
    count, size = session.measured_bytes(tests, [*names, "n", "test"])
    if size > session.BROADCAST_BYTES:
        raise ValueError(f"{count} different message rules take {size} bytes: more than a broadcast of {session.BROADCAST_BYTES} holds")
    of_tests = F.broadcast(tests.select("test", *[F.col(n).alias(f"_{n}") for n in names]))
    ruled = ruled.join(of_tests, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]).select("column", "test", "rule")
    _, listed = session.measured_bytes(plan, ["rule_name", "error_message"])

    def held(tests: DataFrame, name: str | None, item: Column) -> Column:
        """A literal array over the tests of a column in the order of their first rules, read from one text when the plan is made."""
        own = tests.filter(F.col("column").isNull() if name is None else F.col("column") == name).orderBy("test").select(item.alias("item"))
        text = ",".join(r[0] for r in own.select(F.to_json("item")).collect())
        return F.from_json(F.lit(f"[{text}]"), T.ArrayType(own.schema["item"].dataType))

    rows = df if listed <= session.BROADCAST_BYTES else session.placed(df, "_row")
    ready, cells = values.prepared_cells(rows, used, numbers=set(used), dates=set(used))

    def broken(name: str | None) -> Column:
        found = F.transform(held(tests, name, F.struct("test", "n", *_parameters())), lambda r, i: F.struct(i.alias("place"), r.alias("test")))
        if name is not None:
            c = Parsed(cells[name].value, cells[name].number, cells[name].date)
            found = F.filter(found, lambda r: ~message_passes(r["test"]["kind"], c, lambda n: r["test"][n], as_of))
        return F.transform(found, lambda r: F.struct(r["place"].alias("place"), r["test"]["test"].alias("test"), r["test"]["n"].alias("n")))

    groups = {f"_broken_{i}": name for i, name in enumerate([None, *used])}
    ready = ready.withColumns({b: broken(name) for b, name in groups.items()})
    counts = [F.aggregate(b, F.lit(0).cast("long"), lambda total, r: total + r["n"]) for b in groups]
    error_count = sum(counts, F.lit(0).cast("long")).cast("int")
    verdict = {"error_count": error_count, "is_valid": error_count == 0}

    if listed <= session.BROADCAST_BYTES:
        lists = session.stage(ruled.groupBy("column", "test").agg(F.collect_list("rule").alias("rules")), "rule-lists")
        parts = [_at_places(held(lists, name, F.col("rules")), b) for b, name in groups.items()]
        found, violations = ready, F.flatten(F.concat(*parts))
    else:
        each = ready.select("_row", F.explode(F.concat(*groups)).alias("t")).select("_row", F.col("t.test").alias("test"))
        of_row = each.join(ruled, "test").groupBy("_row").agg(F.collect_list("rule").alias("_rules"))
        # The right side has one row for each, so without a reader of the violations Spark leaves the join out.
        found, violations = ready.join(of_row, "_row", "left"), F.coalesce("_rules", F.array())
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.sort_array(violations)["v"].cast(checks.VIOLATION).alias("violations"), *[c.alias(n) for n, c in verdict.items()])
