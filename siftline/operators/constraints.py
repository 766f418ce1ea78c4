"""From the words of a rule message to fields and typed constraints.

The input is any text column; each row of text is one message. Extraction is a
projection of built-in regular-expression functions and so scales with the text
table. The constraints found are ordinary columns that can be joined to data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.functions import fixed, values
from siftline.session import sql_name, sql_text

#: Case-insensitive; only a line feed ends a line.
FLAGS = "(?id)"

CONSTRAINT_COLUMNS = [
    "required", "min_value", "max_value", "min_length", "max_length", "exact_length", "format_type",
    "format_pattern", "allowed_values", "prohibited_values", "condition_field", "condition_value", "is_unique",
    "constraint_types",
]


class Text:
    """A text column prepared for many patterns.

    Every pattern names words without which it cannot match. They are looked up
    once per word in the lower-case text, a plain byte search, and a pattern runs
    only on texts that have one of its words. Nothing is lost by it, and long
    prose is not scanned by fifty patterns in vain. Expressions are SQL text, so
    that one call builds a whole column.
    """

    def __init__(self, name: str, lower: str | None = None, flags: dict[str, str] | None = None):
        self.name = sql_name(name)
        self.lower = lower or f"lower({self.name})"
        self.flags = flags or {}

    @classmethod
    def prepared(cls, df: DataFrame, name: str, words: list[str]) -> tuple[DataFrame, "Text"]:
        """Frame with the lower-case text and one flag per word, and its Text."""
        session.tune(df.sparkSession)
        flags = {w: f"_has_{i}" for i, w in enumerate(dict.fromkeys(words))}
        df = df.selectExpr("*", f"lower({sql_name(name)}) AS _lower")
        df = df.selectExpr("*", *[f"contains(_lower, {sql_text(w)}) AS {f}" for w, f in flags.items()])
        return df, cls(name, "_lower", flags)

    def has(self, words: list[str]) -> str:
        tests = [self.flags.get(w) or f"contains({self.lower}, {sql_text(w)})" for w in words]
        return "(" + " OR ".join(tests) + ")"

    def matches(self, patterns: list[tuple[str, list[str]]]) -> str:
        """Does any pattern match?"""
        return "(" + " OR ".join(f"({self.has(ws)} AND {self.name} RLIKE {sql_text(FLAGS + p)})" for p, ws in patterns) + ")"

    def first(self, patterns: list[tuple[str, list[str]]], group: int = 1) -> str:
        """Capture of the first pattern that matches; null when none does."""
        branches = " ".join(
            f"WHEN {self.matches([(p, ws)])} THEN regexp_extract({self.name}, {sql_text(FLAGS + p)}, {group})" for p, ws in patterns
        )
        return f"CASE {branches} END"

    def all(self, pattern: tuple[str, list[str]], group: int = 1) -> str:
        """All captures of one pattern."""
        p, words = pattern
        found = f"regexp_extract_all({self.name}, {sql_text(FLAGS + p)}, {group})"
        return f"CASE WHEN {self.has(words)} THEN {found} ELSE CAST(array() AS ARRAY<STRING>) END"


def _words(*groups) -> list[str]:
    return [w for group in groups for entry in group for w in entry[-1]]


# --- fields ------------------------------------------------------------------------


def mentions(text: Text, patterns: list[tuple[str, list[str]]]) -> Column:
    """All captures of all patterns, pattern by pattern, that can be field names."""
    names = F.transform(F.concat(*[F.expr(text.all(p)) for p in patterns]), lambda n: F.trim(n, F.lit(values.WHITE)))
    banned = fixed.STOP_WORDS + fixed.RULE_WORDS
    return F.filter(names, lambda n: F.length(n).between(2, 50) & ~F.lower(n).isin(banned))


def distinct_ignoring_case(names: Column) -> Column:
    """First spelling of every name, in order of appearance (n log n)."""
    tagged = F.transform(names, lambda n, i: F.struct(F.lower(n).alias("k"), i.alias("i"), n.alias("n")))

    def firsts(s: Column) -> Column:
        heads = F.filter(s, lambda e, i: (i == 0) | (F.get(s, i - 1)["k"] != e["k"]))
        ordered = F.sort_array(F.transform(heads, lambda e: F.struct(e["i"].alias("i"), e["n"].alias("n"))))
        return F.transform(ordered, lambda e: e["n"])

    # The one-element array binds the sorted list to a lambda variable, so it is built once per row.
    return F.element_at(F.transform(F.array(F.sort_array(tagged)), firsts), 1)


def extract_fields(df: DataFrame, text: str, out: str = "fields") -> DataFrame:
    """Adds the array of field names mentioned in a text column."""
    ready, t = Text.prepared(df, text, _words(fixed.FIELD_MENTIONS))
    found = distinct_ignoring_case(mentions(t, fixed.FIELD_MENTIONS))
    return ready.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(out))


# --- constraints -----------------------------------------------------------------------


def extract_constraints(df: DataFrame, text: str, with_units: bool = False) -> DataFrame:
    """Adds one typed column per constraint kind (see ``CONSTRAINT_COLUMNS``).

    The first pattern of a group that matches gives its value. A text about
    characters limits lengths only, and the specific length forms (at least,
    at most, between) go before the exact one.
    """
    ranges = fixed.RANGE_TEXT_WITH_UNIT if with_units else fixed.RANGE_TEXT
    formats = [p for _, ps in fixed.FORMAT_TEXT for p in ps]
    words = _words(
        fixed.REQUIRED_TEXT, ranges, fixed.MINIMUM_TEXT, fixed.MAXIMUM_TEXT, fixed.LENGTH_TEXT, formats,
        fixed.CUSTOM_FORMAT_TEXT, fixed.ALLOWED_TEXT, fixed.PROHIBITED_TEXT, fixed.CONDITION_TEXT, fixed.UNIQUE_TEXT,
    )
    ready, t = Text.prepared(df, text, [*words, fixed.LENGTH_WORD])
    # No number can be found in a text without a digit.
    ready = ready.withColumn("_digit", F.col(text).rlike("[0-9]"))
    about_length = t.has([fixed.LENGTH_WORD])

    def value(patterns: list, group: int = 1) -> str:
        return f"CASE WHEN _digit AND NOT {about_length} THEN try_cast({t.first(patterns, group)} AS DOUBLE) END"

    lengths = [(p, ws) for _, p, ws in fixed.LENGTH_TEXT]
    spans = [(p, ws) for k, p, ws in fixed.LENGTH_TEXT if k == "length_range"]
    kinds = " ".join(f"WHEN {t.matches([(p, ws)])} THEN '{k}'" for k, p, ws in fixed.LENGTH_TEXT)
    format_kinds = " ".join(f"WHEN {t.matches(ps)} THEN '{name}'" for name, ps in fixed.FORMAT_TEXT)

    found = {
        "required": f"coalesce({t.matches(fixed.REQUIRED_TEXT)}, false)",
        "_low": value(ranges, 1),
        "_high": value(ranges, 2),
        "_minimum": value(fixed.MINIMUM_TEXT),
        "_maximum": value(fixed.MAXIMUM_TEXT),
        "_length_kind": f"CASE WHEN _digit THEN CASE {kinds} END END",
        "_first_number": f"CASE WHEN _digit THEN try_cast({t.first(lengths)} AS BIGINT) END",
        "_second_number": f"CASE WHEN _digit THEN try_cast({t.first(spans, 2)} AS BIGINT) END",
        "format_type": f"CASE {format_kinds} END",
        "format_pattern": t.first(fixed.CUSTOM_FORMAT_TEXT),
        "_allowed_0": t.all(fixed.ALLOWED_TEXT[0]),
        "_allowed_1": t.all(fixed.ALLOWED_TEXT[1], 1),
        "_allowed_2": t.all(fixed.ALLOWED_TEXT[1], 2),
        "_allowed_3": t.all(fixed.ALLOWED_TEXT[2]),
        **{f"_prohibited_{i}": t.all(p) for i, p in enumerate(fixed.PROHIBITED_TEXT)},
        "condition_field": f"trim({t.first(fixed.CONDITION_TEXT, 1)})",
        "condition_value": f"trim({t.first(fixed.CONDITION_TEXT, 2)})",
        "is_unique": f"coalesce({t.matches(fixed.UNIQUE_TEXT)}, false)",
    }
    step = ready.selectExpr(*[sql_name(c) for c in df.columns], *[f"{e} AS {n}" for n, e in found.items()])

    def filled(name: str) -> Column:
        return F.when(F.size(name) > 0, F.col(name))

    # The second form has two captures per match; both count when present.
    pairs = F.filter(F.flatten(F.zip_with("_allowed_1", "_allowed_2", lambda a, b: F.array(a, b))), lambda v: v != "")
    step = step.withColumns(
        {
            "allowed_values": F.coalesce(
                F.when(F.size("_allowed_0") > 0, F.regexp_extract_all(F.array_join("_allowed_0", " "), F.lit(fixed.QUOTED), F.lit(1))), F.when(F.size("_allowed_1") > 0, pairs), filled("_allowed_3")
            ),
            "prohibited_values": F.coalesce(*[filled(f"_prohibited_{i}") for i in range(len(fixed.PROHIBITED_TEXT))]),
        }
    )
    ranged = F.col("_low").isNotNull()
    length_kind = F.col("_length_kind")
    types = F.array_compact(
        F.array(
            F.when(F.col("required"), F.lit("required")),
            F.when(ranged, F.lit("range")),
            F.when(~ranged & F.col("_minimum").isNotNull(), F.lit("minimum")),
            F.when(~ranged & F.col("_maximum").isNotNull(), F.lit("maximum")),
            length_kind,
            F.when(F.col("format_type").isNotNull(), F.lit("format")),
            F.when(F.col("format_pattern").isNotNull(), F.lit("custom_format")),
            F.when(F.col("allowed_values").isNotNull(), F.lit("allowed_values")),
            F.when(F.col("prohibited_values").isNotNull(), F.lit("prohibited_values")),
            F.when(F.col("condition_field").isNotNull(), F.lit("conditional")),
            F.when(F.col("is_unique"), F.lit("unique")),
        )
    )
    number = F.col("_first_number")
    return step.select(
        *df.columns,
        "required",
        F.coalesce("_low", "_minimum").alias("min_value"),
        F.coalesce("_high", "_maximum").alias("max_value"),
        F.when(length_kind.isin("min_length", "length_range"), number).alias("min_length"),
        F.when(length_kind == "max_length", number)
        .when(length_kind == "length_range", F.col("_second_number"))
        .alias("max_length"),
        F.when(length_kind == "exact_length", number).alias("exact_length"),
        "format_type",
        "format_pattern",
        "allowed_values",
        "prohibited_values",
        "condition_field",
        "condition_value",
        "is_unique",
        types.alias("constraint_types"),
    )


def classify_logic(types: Column | str = "constraint_types") -> Column:
    """Which single check the constraints of a message ask for."""
    t = session.col(types)

    def has(*names: str) -> Column:
        found = F.lit(False)
        for name in names:
            found = found | F.array_contains(t, name)
        return found

    return (
        F.when(has("range"), "range_validation")
        .when(has("minimum") & has("maximum"), "min_max_validation")
        .when(has("minimum"), "minimum_validation")
        .when(has("maximum"), "maximum_validation")
        .when(has("length_range"), "length_range_validation")
        .when(has("min_length", "max_length"), "length_validation")
        .when(has("exact_length"), "exact_length_validation")
        .when(has("format", "custom_format"), "format_validation")
        .when(has("allowed_values"), "allowed_values_validation")
        .when(has("prohibited_values"), "prohibited_values_validation")
        .when(has("conditional"), "conditional_validation")
        .when(has("unique"), "uniqueness_validation")
        .when(has("required"), "required_validation")
        .otherwise("default_validation")
    )


# --- applying constraints -----------------------------------------------------------------


def picture_pattern(picture: Column) -> Column:
    """``ABC-123`` as a pattern: letters for letters, digits for digits."""
    escaped = F.regexp_replace(picture, r"([^A-Za-z0-9])", r"\\$1")
    marked = F.regexp_replace(F.regexp_replace(escaped, "[A-Za-z]", "\u0001"), "[0-9]", "\u0002")
    return F.concat(
        F.lit("^"), F.replace(F.replace(marked, F.lit("\u0001"), F.lit("[A-Za-z]")), F.lit("\u0002"), F.lit("[0-9]")), F.lit("$")
    )


def _format_ok(value: Column, date: Column, format_type: Column, picture: Column) -> Column:
    after_at = F.element_at(F.split(value, "@"), -1)
    digits = F.regexp_replace(value, "[^0-9]", "")
    by_type = (
        F.when(format_type == "email", value.contains("@") & after_at.contains("."))
        .when(format_type == "phone", F.length(digits) >= 10)
        .when(format_type == "date", date.isNotNull())
        .when(format_type == "url", value.rlike(fixed.URL))
        .when(format_type == "zip", value.rlike(r"^[0-9]{5}(?:-[0-9]{4})?$"))
        .when(format_type == "ssn", value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))
    )
    by_picture = F.when(picture.isNotNull(), F.regexp(value, picture_pattern(picture)))
    return F.coalesce(by_picture, by_type, F.lit(True))


def parsed_cells(cells: DataFrame) -> DataFrame:
    """Cells (``value``) with ``stripped``, ``number`` and ``date``, each worked out once."""
    cells = cells.withColumn("stripped", values.strip("value"))
    return cells.select(
        "*", values.stripped_number("stripped").alias("number"), values.stripped_timestamp("stripped").alias("date")
    )


def constraint_passes(k: dict[str, Column]) -> Column:
    """Does a parsed cell keep the constraints ``k`` (one Column per name)?

    A blank fails only when required; a value that should be a number and is
    not one fails; uniqueness is a property of the table, not of a value.
    """
    v, n = F.col("stripped"), F.col("number")
    size = F.length(v)
    logic = k["logic"]
    at_least = F.coalesce(n >= k["min_value"], F.lit(False))
    at_most = F.coalesce(n <= k["max_value"], F.lit(False))
    not_blank = (
        F.when(logic.isin("range_validation", "min_max_validation"), at_least & at_most)
        .when(logic == "minimum_validation", at_least)
        .when(logic == "maximum_validation", at_most)
        .when(
            logic.isin("length_range_validation", "length_validation"),
            F.coalesce(size >= k["min_length"], F.lit(True)) & F.coalesce(size <= k["max_length"], F.lit(True)),
        )
        .when(logic == "exact_length_validation", size == k["exact_length"])
        .when(logic == "format_validation", _format_ok(v, F.col("date"), k["format_type"], k["format_pattern"]))
        .when(logic == "allowed_values_validation", F.array_contains(k["allowed_values"], v))
        .when(logic == "prohibited_values_validation", ~F.array_contains(k["prohibited_values"], v))
        .otherwise(F.lit(True))
    )
    return F.when(_blank_cell(), ~k["required"]).otherwise(not_blank)


def _blank_cell() -> Column:
    return F.col("stripped").isNull() | (F.col("stripped") == "")


def constraint_reason(field: Column, passed: Column, k: dict[str, Column]) -> Column:
    """Why the cell passed or failed."""
    v = F.col("stripped")
    logic = k["logic"]

    def both(yes: list, no: list) -> Column:
        return F.when(passed, F.concat(*yes)).otherwise(F.concat(*no))

    def s(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("none"))

    span = [F.lit("["), s(k["min_value"]), F.lit(", "), s(k["max_value"]), F.lit("]")]
    length_span = [F.lit("["), s(k["min_length"]), F.lit(", "), s(k["max_length"]), F.lit("]")]
    size = F.length(v).cast("string")
    checked = (
        F.when(
            logic.isin("range_validation", "min_max_validation"),
            both([F.lit("Value "), v, F.lit(" is within range "), *span], [F.lit("Value "), v, F.lit(" is outside range "), *span]),
        )
        .when(
            logic == "minimum_validation",
            both(
                [F.lit("Value "), v, F.lit(" meets minimum requirement of "), s(k["min_value"])],
                [F.lit("Value "), v, F.lit(" is below minimum requirement of "), s(k["min_value"])],
            ),
        )
        .when(
            logic == "maximum_validation",
            both(
                [F.lit("Value "), v, F.lit(" meets maximum requirement of "), s(k["max_value"])],
                [F.lit("Value "), v, F.lit(" exceeds maximum requirement of "), s(k["max_value"])],
            ),
        )
        .when(
            logic.isin("length_range_validation", "length_validation"),
            both(
                [F.lit("Length "), size, F.lit(" is within range "), *length_span],
                [F.lit("Length "), size, F.lit(" is outside range "), *length_span],
            ),
        )
        .when(
            logic == "exact_length_validation",
            both(
                [F.lit("Length "), size, F.lit(" matches required length "), s(k["exact_length"])],
                [F.lit("Length "), size, F.lit(" does not match required length "), s(k["exact_length"])],
            ),
        )
        .when(
            logic == "format_validation",
            F.concat(
                F.initcap(F.coalesce(k["format_type"], F.lit("custom"))),
                F.when(passed, F.lit(" format is valid")).otherwise(F.lit(" format is invalid")),
            ),
        )
        .when(
            logic == "allowed_values_validation",
            both([F.lit("Value '"), v, F.lit("' is in allowed list")], [F.lit("Value '"), v, F.lit("' is not in allowed list")]),
        )
        .when(
            logic == "prohibited_values_validation",
            both([F.lit("Value '"), v, F.lit("' is not in prohibited list")], [F.lit("Value '"), v, F.lit("' is in prohibited list")]),
        )
        .when(logic == "required_validation", F.concat(F.lit("Required field '"), field, F.lit("' has value")))
        .otherwise(F.concat(F.lit("Default validation passed for field '"), field, F.lit("'")))
    )
    return F.when(
        _blank_cell(),
        both([F.lit("Empty field '"), field, F.lit("' is acceptable")], [F.lit("Required field '"), field, F.lit("' is empty")]),
    ).otherwise(checked)


def unpivot(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """(row_id, field, value as text), one row per cell."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    )
    return df.select(F.col(row_id).alias("row_id"), F.inline(pairs))


def join_by_field(long: DataFrame, staged: DataFrame, salt_buckets: int = 256) -> DataFrame:
    """Cells x the staged rules of their field.

    There are few fields and every row has each of them, so an ordinary shuffle
    on the field would be all skew. A rules table of measured size is broadcast;
    a larger one is copied to every salt bucket of the cells.
    """
    _, size = session.measured_bytes(staged, staged.columns)
    if size <= session.BROADCAST_BYTES:
        return long.join(F.broadcast(staged), "field")
    salted = long.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salt_buckets)))
    copies = staged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))).cast("long"))
    return salted.join(copies, ["field", "_salt"]).drop("_salt")


def apply_constraints(df: DataFrame, row_id: str, constraints: DataFrame) -> DataFrame:
    """Verdict of every row on every constraint of a column it has.

    ``constraints`` has a column ``field`` (a column name of ``df``), optionally
    ``rule_name``, and the columns of ``extract_constraints``. Constraints on
    columns that ``df`` lacks pass and give no rows. Only the columns that constraints
    name are read.
    """
    if "rule_name" not in constraints.columns:
        constraints = constraints.withColumn("rule_name", F.col("field"))
    listed = constraints.select("rule_name", "field", *CONSTRAINT_COLUMNS).withColumn("logic", classify_logic())
    rules = session.stage(listed.filter(F.col("field").isin([c for c in df.columns if c != row_id])), "rules")
    # Only columns of the frame are left, so the names that come here are no more than it has.
    named = {r["field"] for r in rules.select("field").distinct().collect()}
    cells = unpivot(df, row_id, [c for c in df.columns if c in named] or df.columns[:1])
    joined = join_by_field(parsed_cells(cells), rules)
    k = {name: F.col(name) for name in [*CONSTRAINT_COLUMNS, "logic"]}
    judged = joined.withColumn("passed", constraint_passes(k))
    return judged.select(
        "row_id",
        "rule_name",
        "field",
        "logic",
        "passed",
        constraint_reason(F.col("field"), F.col("passed"), k).alias("reason"),
    )
