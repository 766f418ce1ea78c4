"""The three main flows as one lazy plan each."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.operators import checks, cleaning, load, lookup, mapping, report, rules


@dataclass(frozen=True)
class Checked:
    """A checked table with its reports."""

    rows: DataFrame
    violations: DataFrame
    report: DataFrame
    by_field: DataFrame
    by_category: DataFrame


def _reports(checked: DataFrame, row_id: str) -> Checked:
    # Staged once: rows and reports all come from the same checked table.
    staged = session.stage(checked, "checked")
    found = checks.violations_table(staged, row_id)
    total = staged.count()
    return Checked(
        staged,
        found,
        report.error_report(staged),
        report.errors_by(found, "field", total),
        report.errors_by(found, "category", total),
    )


def check_against_catalog(
    df: DataFrame,
    catalog: DataFrame,
    row_id: str,
    column_mapping: dict[str, str] | None = None,
    object_name: str | None = None,
    switches: checks.Switches = checks.Switches(),
) -> Checked:
    """Map nothing, check every mapped column in place, report."""
    return _reports(checks.validate_schema(df, catalog, column_mapping, object_name, switches), row_id)


def check_rules(df: DataFrame, rule_table: DataFrame, row_id: str, as_of: dt.date | None = None) -> Checked:
    """Predicate rules (a ``predicate`` column) or message rules (``error_message``)."""
    if "predicate" in rule_table.columns:
        return _reports(rules.validate_frame(df, rule_table), row_id)
    return _reports(rules.message_rule_check(df, rule_table, row_id, as_of), row_id)


def transform(
    df: DataFrame,
    column_mapping: dict[str, str],
    row_id: str,
    lookups: list[lookup.Lookup],
    catalog: DataFrame,
    object_name: str | None = None,
) -> DataFrame:
    """Map, resolve lookups, clean, and judge every row (``row_id`` is a target name)."""
    names = [x.column for x in lookups]
    mapped = lookup.keep_before(mapping.apply_mapping(df, column_mapping), names)
    cleaned = cleaning.clean_values(lookup.resolve_lookups(mapped, lookups))
    return lookup.categorize_transform(cleaned, None, row_id, names, catalog, object_name)


def load_batches(
    ready: DataFrame, target: DataFrame, key: str, op: str = "upsert", batch_size: int = 10_000
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new snapshot, outcome per source row, report per batch)."""
    batched = load.assign_batches(ready, [key], batch_size).drop("row_index")
    merged = session.stage(load.upsert(batched, target, key, op, carry=["batch_num"]), "merged")
    outcomes = load.upsert_outcomes(merged)
    results = outcomes.withColumn("success", F.col("outcome").isin("created", "updated"))
    return (
        load.upsert_snapshot(merged).drop("batch_num"),
        outcomes,
        load.batch_report(load.batch_results(results)),
    )
