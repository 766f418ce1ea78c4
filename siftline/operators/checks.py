"""Row checks against a target field catalogue.

A check is a boolean Column that is true when the cell breaks it. All checks of
a frame are fused into one array of violation structs: one scan, no UDF.
Uniqueness is the only check that needs a shuffle and is separate.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.functions import fixed, values
from siftline.functions.values import Cell, cell
from siftline.operators import keyed

#: Picklists up to this many values are tested in place; larger ones are joined. Results are equal.
INLINE_PICKLIST = 1000
#: Field types whose checks read the number or the date of a cell.
NUMBER_KINDS = {"int", "integer", "double", "currency", "percent", "number", "string", "textarea", "text"}
DATE_KINDS = {"date", "datetime"}
PICKLIST_KINDS = {"picklist", "multipicklist"}
VIOLATION = (
    "array<struct<rule:string,field:string,category:string,severity:string,message:string>>"
)


# --- single checks: true = the cell breaks the rule ---------------------------


def required(c: Cell, trim: bool = True) -> Column:
    if trim or not c.is_text:
        return c.blank
    return values.blank(c.value, trim=False)


def not_integer(c: Cell) -> Column:
    if c.is_whole or c.is_boolean:
        return F.lit(False)
    n = c.number
    finite = ~F.isnan(n) & (F.abs(n) != F.lit(float("inf")))
    return ~F.coalesce(finite & (n == F.floor(n)), F.lit(False))


def not_number(c: Cell) -> Column:
    if c.is_numeric or c.is_boolean:
        return F.lit(False)
    return c.number.isNull()


def not_boolean(c: Cell) -> Column:
    return ~F.lower(c.text).isin(fixed.BOOLEAN_TOKENS)


def not_date(c: Cell) -> Column:
    return F.lit(False) if c.is_date else c.date.isNull()


def bad_email(c: Cell) -> Column:
    return ~c.text.rlike(fixed.EMAIL)


def bad_email_lenient(c: Cell) -> Column:
    """As ``bad_email``, but trims and lets boolean-like text pass."""
    return ~F.lower(c.stripped).isin("true", "false", "") & ~c.stripped.rlike(fixed.EMAIL)


def bad_phone(c: Cell) -> Column:
    return ~F.regexp_replace(c.stripped, fixed.PHONE_PUNCTUATION, "").rlike(fixed.PHONE_DIGITS)


def bad_url(c: Cell) -> Column:
    return ~c.text.rlike(fixed.URL)


def suspicious_number(c: Cell, field: str | None = None) -> Column:
    """A large all-digit text in a field that should hold words."""
    name = (field or c.name).lower()
    if any(word in name for word in fixed.NUMBER_FIELD_WORDS):
        return F.lit(False)
    address = any(word in name for word in fixed.ADDRESS_FIELD_WORDS)
    limit = fixed.ADDRESS_NUMBER_LIMIT if address else fixed.TEXT_NUMBER_LIMIT
    # Few texts look like a number at all, so the costlier test comes second.
    return F.coalesce((c.number > limit) & c.stripped.rlike(r"^[.+\-]*[0-9][0-9.+\-]*$"), F.lit(False))


def bad_record_id(c: Cell) -> Column:
    return ~F.length(c.stripped).isin(fixed.RECORD_ID_LENGTHS)


def bad_currency(c: Cell) -> Column:
    if c.is_numeric:
        return F.lit(False)
    return values.number(F.regexp_replace(c.text, r"[$,]", "")).isNull()


def bad_percent(c: Cell) -> Column:
    """Not a number, or outside 0..100 (NaN is not below or above either)."""
    n = c.number if c.is_numeric else values.number(F.replace(c.text, F.lit("%"), F.lit("")))
    return n.isNull() | (~F.isnan(n) & ((n < 0) | (n > 100)))


def percent_out_of_range(c: Cell) -> Column:
    n = c.number if c.is_numeric else values.number(F.replace(c.text, F.lit("%"), F.lit("")))
    return F.coalesce(~F.isnan(n) & ((n < 0) | (n > 100)), F.lit(False))


def too_long(c: Cell, limit: int) -> Column:
    return F.length(c.text) > limit


def not_in_picklist(c: Cell, allowed: list[str], trim: bool = False) -> Column:
    if not allowed:
        return F.lit(False)
    return ~(c.stripped if trim else c.text).isin(list(allowed))


# --- fusing checks ---------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    rule: str
    field: str
    category: str
    failed: Column
    message: Column
    severity: str = "error"

    def violation(self) -> Column:
        return F.struct(
            F.lit(self.rule).alias("rule"),
            F.lit(self.field).alias("field"),
            F.lit(self.category).alias("category"),
            F.lit(self.severity).alias("severity"),
            self.message.alias("message"),
        )


def with_violations(df: DataFrame, checks: list[Check], warnings_fail: bool = True) -> DataFrame:
    """Adds ``violations``, ``error_count`` and ``is_valid`` in one projection.

    The count comes from the predicates, so a consumer of the verdict alone
    never builds the messages.
    """
    session.tune(df.sparkSession)
    plain = list(df.columns)
    flags = [c.failed.alias(f"_failed_{i}") for i, c in enumerate(checks)]
    flagged = df.select("*", *flags)
    checks = [replace(c, failed=F.col(f"_failed_{i}")) for i, c in enumerate(checks)]
    none = F.array().cast(VIOLATION)
    found = [F.when(c.failed, F.array(c.violation())).otherwise(none) for c in checks]
    failing = [c for c in checks if warnings_fail or c.severity == "error"]
    count = sum((F.when(c.failed, 1).otherwise(0) for c in failing), F.lit(0))
    return flagged.select(
        *[F.col(f"`{c}`") for c in plain],
        (F.concat(*found) if found else none).alias("violations"),
        count.alias("error_count"),
        (count == 0).alias("is_valid"),
    )


def violations_table(checked: DataFrame, row_id: str) -> DataFrame:
    """One row per violation: (row_id, rule, field, category, severity, message).

    The outer form of explode keeps the optimizer from testing the size of the
    array, and so evaluating all checks, once more in a filter below.
    """
    exploded = checked.select(F.col(row_id).alias("row_id"), F.explode_outer("violations").alias("v"))
    return exploded.filter(F.col("v").isNotNull()).select("row_id", "v.*")


# --- the catalogue ------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """One row of the field catalogue, as needed to build Columns."""

    name: str
    type: str = "string"
    length: int | None = None
    nillable: bool = True
    is_unique: bool = False
    picklist: tuple[str, ...] = ()
    #: True when the picklist is too large to be tested in place.
    large_picklist: bool = False


def read_fields(catalog: DataFrame, names: list[str], object_name: str | None = None) -> list[Field]:
    """Catalogue rows for the given field names (so at most one per column)."""
    wanted = catalog.filter(F.col("name").isin(list(names)))
    if object_name is not None:
        wanted = wanted.filter(F.col("object") == object_name)
    active = F.transform(F.filter("picklist", lambda p: F.coalesce(p["active"], F.lit(True))), lambda p: p["value"])
    slim = wanted.select(
        "name",
        "type",
        "length",
        "nillable",
        "is_unique",
        F.when(F.size(active) <= INLINE_PICKLIST, active).alias("values"),
        (F.size(active) > INLINE_PICKLIST).alias("large"),
    )
    rows = slim.limit(2 * len(names) + 1).collect()
    seen = [r["name"] for r in rows]
    if twice := sorted({n for n in seen if seen.count(n) > 1}):
        raise ValueError(f"the catalogue has several fields named {', '.join(twice)}: give object_name")
    return [
        Field(
            r["name"],
            r["type"] or "string",
            r["length"],
            True if r["nillable"] is None else r["nillable"],
            bool(r["is_unique"]),
            tuple(r["values"] or ()),
            bool(r["large"]),
        )
        for r in rows
    ]


@dataclass(frozen=True)
class Switches:
    required: bool = True
    types: bool = True
    formats: bool = True
    lengths: bool = True
    picklists: bool = True
    type_length_limits: bool = False


def field_checks(c: Cell, field: Field, on: Switches = Switches(), listed: Column | None = None) -> list[Check]:
    """All enabled checks of one column against one catalogue field.

    ``listed`` tells for a large picklist whether the cell is in it.
    """
    shown = F.lit(f"field '{c.name}' (mapped to '{field.name}')" if c.name != field.name else f"field '{c.name}'")
    kind = field.type.lower()
    present = ~c.blank
    out: list[Check] = []

    def add(rule: str, category: str, failed: Column, *message, severity: str = "error") -> None:
        out.append(Check(rule, c.name, category, failed, F.concat(*message), severity))

    if on.required and not field.nillable:
        add("required", "Required Field Errors", required(c), F.lit("Required "), shown, F.lit(" is empty"))

    if on.types:
        if kind == "email":
            add("type_email", "Format Errors", present & bad_email(c), F.lit("Invalid email format in "), shown, F.lit(": "), c.text)
        elif kind == "phone":
            add("type_phone", "Format Errors", present & bad_phone(c), F.lit("Invalid phone format in "), shown, F.lit(": "), c.text)
        elif kind in ("int", "integer"):
            add("type_int", "Data Type Errors", present & not_integer(c), F.lit("Invalid integer value in "), shown, F.lit(": "), c.text)
        elif kind in ("double", "currency", "percent", "number"):
            add("type_number", "Data Type Errors", present & not_number(c), F.lit("Invalid numeric value in "), shown, F.lit(": "), c.text)
        elif kind == "boolean":
            add("type_boolean", "Data Type Errors", present & not_boolean(c), F.lit("Invalid boolean value in "), shown, F.lit(": "), c.text)
        elif kind in ("date", "datetime"):
            add("type_date", "Format Errors", present & not_date(c), F.lit("Invalid date format in "), shown, F.lit(": "), c.text)
        elif kind == "url":
            add("type_url", "Format Errors", present & bad_url(c), F.lit("Invalid URL format in "), shown, F.lit(": "), c.text)
        elif kind in ("string", "textarea", "text"):
            add("suspicious_numeric_text", "Other Errors", present & suspicious_number(c, field.name),
                F.lit("Warning: numeric value '"), c.text, F.lit("' in text "), shown, severity="warning")
        elif kind in ("reference", "id"):
            add("record_id", "Other Errors", present & bad_record_id(c), F.lit("Invalid record id in "), shown,
                F.lit(": "), c.text, F.lit(" (should be 15 or 18 characters)"))

    if on.formats:
        if kind == "email":
            add("format_email", "Format Errors", present & bad_email(c), F.lit("Invalid email format in "), shown, F.lit(": "), c.text)
        elif kind == "phone":
            add("format_phone", "Format Errors", present & bad_phone(c), F.lit("Invalid phone format in "), shown, F.lit(": "), c.text)
        elif kind in ("date", "datetime"):
            add("format_date", "Format Errors", present & not_date(c), F.lit("Invalid date format in "), shown, F.lit(": "), c.text)
        elif kind == "url":
            add("format_url", "Format Errors", present & bad_url(c), F.lit("Invalid URL format in "), shown, F.lit(": "), c.text)
        elif kind == "currency":
            add("format_currency", "Other Errors", present & bad_currency(c), F.lit("Invalid currency format in "), shown, F.lit(": "), c.text)
        elif kind == "percent":
            add("format_percent", "Other Errors", present & bad_percent(c),
                F.when(percent_out_of_range(c), F.lit("Percent value out of range (0-100) in ")).otherwise(
                    F.lit("Invalid percent format in ")), shown, F.lit(": "), c.text)

    if on.lengths:
        size = F.length(c.text).cast("string")
        if field.length:
            add("max_length", "Length Errors", present & too_long(c, field.length), shown,
                F.lit(f" exceeds maximum length ({field.length}): "), size, F.lit(" characters"))
        limit = fixed.TYPE_LENGTHS.get(kind)
        if on.type_length_limits and limit:
            add("type_length", "Length Errors", present & too_long(c, limit), shown,
                F.lit(f" of type '{kind}' exceeds maximum length of {limit} characters: "), size)

    if on.picklists and kind in PICKLIST_KINDS and (field.picklist or listed is not None):
        add("picklist", "Picklist Errors", present & (not_in_picklist(c, list(field.picklist)) if listed is None else ~listed),
            F.lit("Invalid picklist value in "), shown, F.lit(": "), c.text)
    return out


# --- whole-table checks -----------------------------------------------------------


def picklist_member(df: DataFrame, column: str, allowed: DataFrame, out: str, trim: bool = False) -> DataFrame:
    """Large picklist: adds whether the cell is in ``allowed`` (column ``value``).

    ``allowed`` may be of any size; it is broadcast only after it was measured,
    otherwise the rows' own values are counted first so that a frequent value
    does not land in one task.
    """
    c = cell(df, column)
    value = values.strip(c.value) if trim else c.text
    distinct = session.stage(
        allowed.select(group_key_of("value").alias("key")).distinct().withColumn(out, F.lit(True)), "picklist"
    )
    _, size = session.measured_bytes(distinct, ["key"])
    weight = None
    if size > session.BROADCAST_BYTES:
        weight = "rows"
        counts = keyed.key_counts(df, values.group_key(value))
        distinct = session.stage(counts.join(distinct, "key"), "picklist-used")
    joined = keyed.attach_by_key(df, values.group_key(value), distinct, [out], weight=weight)
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def picklist_flags(
    df: DataFrame, catalog: DataFrame, columns: dict[str, str], object_name: str | None = None, trim: bool = False
) -> tuple[DataFrame, dict[str, Column]]:
    """For columns (to field names) with large picklists: the frame with a flag each, true for listed cells."""
    flags: dict[str, Column] = {}
    for i, (source, target) in enumerate(columns.items()):
        listed = catalog.filter(F.col("name") == target)
        if object_name is not None:
            listed = listed.filter(F.col("object") == object_name)
        active = listed.select(F.explode("picklist").alias("p")).filter(F.coalesce(F.col("p.active"), F.lit(True)))
        value = values.strip(F.col("p.value")) if trim else F.col("p.value")
        allowed = active.select(value.alias("value")).filter("value <> ''" if trim else "true")
        df = picklist_member(df, source, allowed, f"_listed_{i}", trim=trim)
        flags[source] = F.col(f"_listed_{i}")
    return df, flags


def group_key_of(name: str) -> Column:
    return values.group_key(F.col(name))


def unique_violations(df: DataFrame, row_id: str, columns: list[str], trim: bool = True) -> DataFrame:
    """Every member of every duplicate group: (row_id, field, value, rows).

    Null and blank values are ignored (``trim=False``: only null). The rows of a
    group stay rows; they are never gathered into one array.
    """
    parts = []
    cells = [cell(df, name) for name in columns]
    repeated = keyed.repeated_values(df, [(c.value, c.blank if trim else c.missing) for c in cells])
    for i, (name, c) in enumerate(zip(columns, cells, strict=True)):
        shown = F.when(~(c.blank if trim else c.missing), c.value)
        slim = df.select(F.col(row_id).alias("row_id"), shown.alias(name))
        flagged = keyed.attach_repeated(slim, F.col(f"`{name}`"), repeated, i, "rows")
        parts.append(
            flagged.filter(F.col("rows").isNotNull()).select(
                "row_id", F.lit(name).alias("field"), F.col(f"`{name}`").cast("string").alias("value"), "rows"
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unique_checks(df: DataFrame, columns: list[str], trim: bool = True) -> tuple[DataFrame, list[Check]]:
    """Frame with one duplicate-count column per unique field, and its checks."""
    checks = []
    if not columns:
        return df, checks
    cells = [cell(df, name) for name in columns]
    ignored = [c.blank if trim else c.missing for c in cells]
    repeated = keyed.repeated_values(df, [(c.value, x) for c, x in zip(cells, ignored, strict=True)])
    for i, (name, c) in enumerate(zip(columns, cells, strict=True)):
        out = f"_dup_{i}"
        df = keyed.attach_repeated(df, F.when(~ignored[i], c.value), repeated, i, out)
        message = F.concat(
            F.lit("Duplicate value '"), c.text, F.lit(f"' found in unique field '{name}' ("), F.col(out).cast("string"), F.lit(" rows)")
        )
        checks.append(Check("unique", name, "Unique Constraint Errors", F.col(out).isNotNull(), message))
    return df, checks


def unknown_columns(columns: list[str], catalog: DataFrame) -> DataFrame:
    """Data columns that the catalogue does not have, in data order."""
    found = {f.name for f in read_fields(catalog, columns)}
    rows = [(c,) for c in columns if c not in found]
    return catalog.sparkSession.createDataFrame(rows, "column string")


def validate_schema(
    df: DataFrame,
    catalog: DataFrame,
    mapping: dict[str, str] | None = None,
    object_name: str | None = None,
    switches: Switches = Switches(),
    warnings_fail: bool = True,
    unique_fails_row: bool = False,
) -> DataFrame:
    """All catalogue checks of all mapped columns, with a verdict per row.

    ``mapping`` is source column to field name (identity when omitted).
    Uniqueness does not change the verdict unless ``unique_fails_row`` is set.
    """
    mapping = {c: c for c in df.columns} if mapping is None else mapping
    mapping = {s: t for s, t in mapping.items() if t and t != fixed.SKIP_FIELD and s in df.columns}
    by_name = {f.name: f for f in read_fields(catalog, list(mapping.values()), object_name)}
    columns = list(df.columns)
    checks: list[Check] = []
    kinds = {s: by_name[t].type.lower() for s, t in mapping.items() if t in by_name}
    df, ready = values.prepared_cells(
        df,
        list(kinds),
        numbers={s for s, k in kinds.items() if k in NUMBER_KINDS},
        dates={s for s, k in kinds.items() if k in DATE_KINDS},
    )
    large = {s: t for s, t in mapping.items() if t in by_name and by_name[t].large_picklist and kinds[s] in PICKLIST_KINDS}
    df, flags = picklist_flags(df, catalog, large if switches.picklists else {}, object_name)
    for source, target in mapping.items():
        field = by_name.get(target)
        if field is None:
            continue
        checks += field_checks(ready[source], field, switches, flags.get(source))
    if unique_fails_row:
        unique = [s for s, t in mapping.items() if t in by_name and by_name[t].is_unique]
        df, more = unique_checks(df, unique)
        checks += more
    return with_violations(df, checks, warnings_fail).select(*columns, "violations", "error_count", "is_valid")


def issues_column(df: DataFrame, catalog: DataFrame, object_name: str | None = None) -> DataFrame:
    """Catalogue-file form: adds ``Issues``, the ``; ``-joined findings of a row.

    Required cells are tested without trimming; any column with "email" in its
    name is tested; picklists compare trimmed values; duplicates ignore null only.
    """
    fields = {f.name: f for f in read_fields(catalog, df.columns, object_name)}
    columns = list(df.columns)
    df, _ = unique_checks(df, [n for n in columns if n in fields and fields[n].is_unique], trim=False)
    dup = {n: f"_dup_{i}" for i, n in enumerate(n for n in columns if n in fields and fields[n].is_unique)}
    df, by_name = values.prepared_cells(df, columns, numbers=set(), dates=set())
    large = {n: n for n in columns if n in fields and fields[n].type == "picklist" and fields[n].large_picklist}
    df, flags = picklist_flags(df, catalog, large, object_name, trim=True)
    parts = []
    for name in columns:
        if name in fields and not fields[name].nillable:
            parts.append(F.when(required(by_name[name], trim=False), F.lit(f"Required field '{name}' data is missing")))
    for name in columns:
        if "email" in name.lower():
            c = by_name[name]
            present = ~values.blank(c.value, trim=False)
            parts.append(F.when(present & bad_email_lenient(c), F.lit(f"Invalid email format in '{name}'")))
    for name, flag in dup.items():
        parts.append(F.when(F.col(flag).isNotNull(), F.lit(f"Duplicate value in unique field '{name}'")))
    for name in columns:
        if name in fields and fields[name].type == "picklist" and (fields[name].picklist or name in flags):
            c = by_name[name]
            allowed = [v for v in (x.strip(values.WHITE) for x in fields[name].picklist) if v]  # as cells are stripped
            wrong = ~flags[name] if name in flags else not_in_picklist(c, allowed, trim=True)
            parts.append(F.when(~c.blank & wrong, F.lit(f"Invalid picklist value in '{name}'")))
    issues = F.concat_ws("; ", *parts) if parts else F.lit("")
    return df.select(*columns, issues.alias("Issues"))


def required_issues(with_issues: DataFrame, catalog: DataFrame, object_name: str | None = None) -> DataFrame | None:
    """Required columns + ``Issues``; None when a required column is missing."""
    wanted = catalog.filter(~F.coalesce(F.col("nillable"), F.lit(True)))
    if object_name is not None:
        wanted = wanted.filter(F.col("object") == object_name)
    have = F.col("name").isin(with_issues.columns)
    if not wanted.filter(~have).isEmpty():
        return None
    names = [r["name"] for r in wanted.select("name").collect()]  # as many as columns, by the test above
    return with_issues.select(*names, "Issues")
