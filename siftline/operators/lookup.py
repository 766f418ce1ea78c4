"""Resolving lookup values to record ids, and judging a transform."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.functions import fixed, values
from siftline.operators import checks, keyed


@dataclass(frozen=True)
class Lookup:
    """How one reference column is resolved."""

    column: str
    parent: DataFrame
    match_field: str = "Name"
    id_field: str = "Id"


def looks_like_id(c: Column) -> Column:
    """Letters and digits only, 15 or 18 of them."""
    return F.length(c).isin(fixed.RECORD_ID_LENGTHS) & c.rlike("^[A-Za-z0-9]+$")


def match_table(parent: DataFrame, match: Column, payload: Column, out: str) -> DataFrame:
    """One row per match value with the smallest payload: (key, ``out``)."""
    return (
        parent.select(values.group_key(match).alias("key"), payload.alias(out))
        .filter(F.col("key").isNotNull() & F.col(out).isNotNull())
        .groupBy("key")
        .agg(F.min(out).alias(out))
    )


def attach_match(df: DataFrame, value: Column, table: DataFrame, out: str, broadcast_bytes: int | None = None) -> DataFrame:
    """Adds ``out`` from a (key, ``out``) table to the rows with that value.

    A small table is broadcast. For a large one the distinct values of the rows
    are counted and matched first, so that only used matches travel and a value
    held by many rows cannot overload one task.
    """
    limit = session.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    staged = session.stage(table, "matches")
    _, size = session.measured_bytes(staged, ["key", out])
    key = values.group_key(value)
    if size <= limit:
        return keyed.attach_by_key(df, key, staged, [out], broadcast_bytes=limit)
    used = keyed.key_counts(df, key, "_rows").join(staged, "key")
    return keyed.attach_by_key(
        df, key, session.stage(used, "matches-used"), [out], weight="_rows", broadcast_bytes=limit
    )


def resolve_lookup(df: DataFrame, lookup: Lookup, broadcast_bytes: int | None = None) -> DataFrame:
    """Values of one column replaced by the id of the parent row they name.

    The smallest id wins where several parents match. Null, values that already
    look like an id, and values without a parent stay. The column becomes text.
    """
    c = lookup.column
    parent = match_table(
        lookup.parent, F.col(lookup.match_field).cast("string"), F.col(lookup.id_field).cast("string"), "_resolved"
    )
    text = F.col(f"`{c}`").cast("string")
    open_value = F.when(~looks_like_id(text), text)
    joined = attach_match(df, open_value, parent, "_resolved", broadcast_bytes)
    return joined.select(
        *[F.coalesce("_resolved", text).alias(c) if n == c else F.col(f"`{n}`") for n in df.columns]
    )


#: Prefix of columns that hold the values from before a transform.
BEFORE = "_earlier_"


def keep_before(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame with copies of the given columns as they are now."""
    return df.withColumns({BEFORE + c: F.col(f"`{c}`").cast("string") for c in columns if c in df.columns})


def _dictionary(lookups: list[Lookup]) -> DataFrame:
    """(field, key, _resolved) of all lookups in one table; ``field`` is the place in the list."""
    parts = []
    for i, lookup in enumerate(lookups):
        entry = lookup.parent.select(
            F.lit(i).alias("field"),
            values.group_key(F.col(lookup.match_field).cast("string")).alias("key"),
            F.col(lookup.id_field).cast("string").alias("_resolved"),
        )
        parts.append(entry.filter(F.col("key").isNotNull() & F.col("_resolved").isNotNull()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("field", "key").agg(F.min("_resolved").alias("_resolved"))


def _open_values(lookups: list[Lookup]) -> list[Column]:
    texts = [session.sql_column(lookup.column).cast("string") for lookup in lookups]
    return [F.when(~looks_like_id(text), text) for text in texts]


def resolve_lookups(df: DataFrame, lookups: list[Lookup], broadcast_bytes: int | None = None) -> DataFrame:
    """All reference columns resolved as by ``resolve_lookup``, from one dictionary.

    The parents of all fields are reduced to one staged (field, key, id) table, which is measured once for
    all fields. When it is larger than ``broadcast_bytes``, the distinct (field, value) pairs of the rows are
    counted in one pass over all fields and matched first. A column that is named again is resolved on
    the outcome of its earlier lookup, with a dictionary of its own.
    """
    limit = session.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    first, later, seen = [], [], set()
    for lookup in lookups:
        (later if lookup.column in seen else first).append(lookup)
        seen.add(lookup.column)
    if not first:
        return df
    staged = session.stage(_dictionary(first), "dictionary")
    _, size = session.measured_bytes(staged, ["key", "_resolved"])
    weight = None
    if size > limit:
        pairs = F.array(*[F.struct(F.lit(i).alias("field"), values.group_key(c).alias("key")) for i, c in enumerate(_open_values(first))])
        used = df.select(F.inline(pairs)).filter(F.col("key").isNotNull()).groupBy("field", "key").agg(F.count("*").alias("_rows"))
        staged = session.stage(used.join(staged, ["field", "key"]), "dictionary-used")
        weight = "_rows"
    for i, lookup in enumerate(first):
        c = lookup.column
        table = staged.filter(F.col("field") == i).drop("field")
        value = values.group_key(_open_values([lookup])[0])
        joined = keyed.attach_by_key(
            df, value, table, ["_resolved"], weight=weight, broadcast_bytes=limit, fits=True if weight is None else None
        )
        resolved = F.coalesce("_resolved", session.sql_column(c).cast("string")).alias(c)
        df = joined.select(*[resolved if n == c else session.sql_column(n) for n in df.columns])
    return resolve_lookups(df, later, broadcast_bytes) if later else df


def lookup_report(before: DataFrame, lookups: list[Lookup]) -> DataFrame:
    """(field, resolved_values): distinct values that were replaced, per field."""
    parts = []
    for lookup in lookups:
        text = F.col(f"`{lookup.column}`").cast("string")
        distinct = keyed.key_counts(before, values.group_key(F.when(~looks_like_id(text), text)))
        parent = match_table(
            lookup.parent, F.col(lookup.match_field).cast("string"), F.col(lookup.id_field).cast("string"), "_id"
        )
        parts.append(
            distinct.join(parent, "key", "left_semi").agg(
                F.lit(lookup.column).alias("field"), F.count("*").alias("resolved_values")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_reference_keys(df: DataFrame, references: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """For every (column, parent, parent id, parent key) adds ``<column>.<key>`` of the parent row."""
    for column, parent, id_field, key_field in references:
        table = match_table(parent, F.col(id_field).cast("string"), F.col(key_field).cast("string"), "_parent_key")
        df = attach_match(df, F.col(f"`{column}`").cast("string"), table, "_parent_key").withColumnRenamed(
            "_parent_key", f"{column}.{key_field}"
        )
    return df


# --- outcome of a transform ---------------------------------------------------------------


def _name_list(parts: list[tuple[Column, str]]) -> Column:
    """``['a', 'b']`` of the names whose condition holds."""
    named = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(f"'{n}'")) for c, n in parts])), ", ")
    return F.concat(F.lit("["), named, F.lit("]"))


def categorize_transform(
    after: DataFrame,
    before: DataFrame | None,
    row_id: str,
    lookup_fields: list[str],
    catalog: DataFrame,
    object_name: str | None = None,
    already_id_ok: bool = False,
) -> DataFrame:
    """Adds transform status, reason, details and the three failure flags.

    A row fails when a lookup value is unchanged and not blank, a picklist value
    is not listed, or a unique value repeats. ``already_id_ok`` lets an unchanged
    value pass that already is an id. Without ``before``, ``after`` has the earlier
    values itself (see ``keep_before``), and no join of the two is needed.
    """
    fields = {f.name: f for f in checks.read_fields(catalog, after.columns, object_name)}
    earlier = [c.removeprefix(BEFORE) for c in after.columns if c.startswith(BEFORE)] if before is None else before.columns
    lookups = [f for f in lookup_fields if f in earlier and f in after.columns]
    picks = [n for n, f in fields.items() if f.type == "picklist" and (f.picklist or f.large_picklist)]
    uniques = [n for n in after.columns if n in fields and fields[n].is_unique]
    columns = [c for c in after.columns if before is not None or not c.startswith(BEFORE)]

    df = after
    if before is None:
        df = df.withColumnsRenamed({BEFORE + f: f"_before_{i}" for i, f in enumerate(lookups)})
    elif lookups:
        old = before.select(
            F.col(row_id).alias("_rid"), *[F.col(f"`{f}`").cast("string").alias(f"_before_{i}") for i, f in enumerate(lookups)]
        )
        df = df.join(old, F.col(row_id) == F.col("_rid"), "left").drop("_rid")
    df, unique_checks = checks.unique_checks(df, uniques)
    for i, name in enumerate(picks):
        if fields[name].large_picklist:
            listed = catalog.filter(F.col("name") == name)
            if object_name is not None:
                listed = listed.filter(F.col("object") == object_name)
            active = listed.select(F.explode("picklist").alias("p")).filter(F.coalesce(F.col("p.active"), F.lit(True)))
            df = checks.picklist_member(df, name, active.select(F.col("p.value").alias("value")), f"_listed_{i}", trim=True)

    def now(name: str) -> Column:
        return F.coalesce(values.strip(F.col(f"`{name}`")), F.lit(""))

    unchanged = []
    for i, name in enumerate(lookups):
        same = (F.coalesce(values.strip(F.col(f"_before_{i}")), F.lit("")) == now(name)) & (now(name) != "")
        unchanged.append((same & ~looks_like_id(now(name)) if already_id_ok else same, name))
    bad_pick = [
        (
            (now(n) != "") & (~F.col(f"_listed_{i}") if fields[n].large_picklist else ~now(n).isin(list(fields[n].picklist))),
            n,
        )
        for i, n in enumerate(picks)
    ]
    repeated = [(check.failed, check.field) for check in unique_checks]

    def any_of(parts: list[tuple[Column, str]]) -> Column:
        found = F.lit(False)
        for condition, _ in parts:
            found = found | condition
        return found

    df = df.withColumns(
        {
            "lookup_failed": any_of(unchanged),
            "picklist_failed": any_of(bad_pick),
            "unique_failed": any_of(repeated),
        }
    )
    failed = F.col("lookup_failed") | F.col("picklist_failed") | F.col("unique_failed")
    reasons = []
    details: list[Column] = []
    if unchanged:
        reasons.append(F.when(F.col("lookup_failed"), F.concat(F.lit("Unchanged lookup fields: "), _name_list(unchanged))))
        plain = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in unchanged])), ", ")
        details.append(F.when(F.col("lookup_failed"), F.concat(F.lit("Unchanged: "), plain)))
    if bad_pick:
        reasons.append(F.when(F.col("picklist_failed"), F.concat(F.lit("Invalid picklist values: "), _name_list(bad_pick))))
        details += [F.when(c, F.concat(F.lit(f"Invalid picklist {n}: '"), now(n), F.lit("'"))) for c, n in bad_pick]
    if repeated:
        reasons.append(F.when(F.col("unique_failed"), F.concat(F.lit("Duplicate unique field values: "), _name_list(repeated))))
        details += [
            F.when(c, F.concat(F.lit(f"Duplicate unique {n}: '"), F.col(f"`{n}`").cast("string"), F.lit("'"))) for c, n in repeated
        ]
    passed_reason = (
        "All validations passed (lookup fields transformed, picklist values valid, unique fields unique)"
        if lookups
        else "No validations required (no lookup/picklist/unique fields)"
    )
    return df.select(
        *[F.col(f"`{c}`") for c in columns],
        F.when(failed, "FAILURE").otherwise("SUCCESS").alias("Transform_Status"),
        F.when(failed, F.concat_ws("; ", *reasons)).otherwise(F.lit(passed_reason)).alias("Transform_Reason"),
        F.when(failed, F.concat_ws("; ", *details)).otherwise(F.lit("All validations passed")).alias("Validation_Details"),
        "lookup_failed",
        "picklist_failed",
        "unique_failed",
    )


def transform_summary(categorized: DataFrame) -> DataFrame:
    """Counts, shares and failures by kind, one row."""
    total = F.count("*")
    good = F.count_if(F.col("Transform_Status") == "SUCCESS")
    return categorized.agg(
        good.alias("success_count"),
        (total - good).alias("failure_count"),
        total.alias("total_count"),
        values.percent(good, total).alias("success_percentage"),
        values.percent(total - good, total).alias("failure_percentage"),
        F.count_if("lookup_failed").alias("lookup_failures"),
        F.count_if("picklist_failed").alias("picklist_failures"),
        F.count_if("unique_failed").alias("unique_failures"),
    )


def attach_outcomes(batch: DataFrame, results: DataFrame, row_id: str) -> DataFrame:
    """Service outcomes (row_id, success, errors) next to their input rows."""
    slim = results.select(F.col("row_id").alias("_rid"), "success", "errors")
    return batch.join(slim, F.col(row_id) == F.col("_rid"), "left").select(
        *batch.columns, F.coalesce("success", F.lit(False)).alias("success"), "errors"
    )
