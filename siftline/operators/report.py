"""Reports on checked frames, and small ordering helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline import session
from siftline.functions import fixed, values
from siftline.operators import keyed, load


def error_report(checked: DataFrame) -> DataFrame:
    """Totals, rates, mean errors, worst field and quality level, one row.

    Fields are counted first and the totals are folded from those counts: the
    rows are read once and nothing is joined.
    """
    slim = checked.select("is_valid", F.posexplode_outer("violations").alias("i", "v"))
    first = F.coalesce(F.col("i"), F.lit(0)) == 0
    per_field = slim.groupBy(F.col("v.field").alias("field")).agg(
        F.count("v").alias("errors"),
        F.count_if(first).alias("records"),
        F.count_if(first & F.col("is_valid")).alias("passed"),
    )
    named = F.col("errors") > 0
    totals = per_field.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("passed"), F.lit(0)).alias("passed_records"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"),
        F.count_if(named).alias("fields_with_issues"),
        F.min(F.when(named, F.struct((-F.col("errors")).alias("n"), F.col("field").alias("f")))).alias("worst"),
    )
    rate = values.percent(F.col("passed_records"), F.col("total_records"))
    return totals.select(
        "total_records",
        "passed_records",
        (F.col("total_records") - F.col("passed_records")).alias("failed_records"),
        "total_errors",
        "fields_with_issues",
        F.round(rate, 4).alias("success_rate"),
        F.round(F.when(F.col("total_records") > 0, 100.0 - rate).otherwise(0.0), 4).alias("failure_rate"),
        F.round(
            F.when(F.col("total_records") > 0, F.col("total_errors") / F.col("total_records")).otherwise(0.0), 4
        ).alias("errors_per_record"),
        F.col("worst.f").alias("worst_field"),
        values.band(rate, fixed.QUALITY_LEVELS, fixed.QUALITY_LOWEST).alias("quality"),
    )


def errors_by(violations: DataFrame, dim: str, total_records: int | None = None) -> DataFrame:
    """Violations per ``category``, ``field`` or ``rule``, most frequent first.

    With ``total_records`` the rate per record in percent is added.
    """
    out = violations.groupBy(dim).agg(F.count("*").alias("error_count"))
    if total_records is not None:
        out = out.withColumn(
            "error_rate", F.round(values.percent(F.col("error_count"), F.lit(total_records)), 2)
        )
    return out.orderBy(F.desc("error_count"), dim)


def sample_messages(violations: DataFrame, dim: str, n: int = 3) -> DataFrame:
    """The first ``n`` messages per group in message order: (dim, position, message).

    A rank limit is applied before the shuffle, so a group with most of the
    violations still sends only ``n`` rows per task.
    """
    order = W.partitionBy(dim).orderBy("message", "row_id")
    return (
        violations.select(dim, "message", "row_id", F.row_number().over(order).alias("position"))
        .filter(F.col("position") <= n)
        .select(dim, "position", "message")
    )


def status_column(checked: DataFrame) -> DataFrame:
    """Adds PASSED / FAILED and the joined messages of each row."""
    return checked.withColumn(
        "Validation_Status", F.when(F.col("is_valid"), "PASSED").otherwise("FAILED")
    ).withColumn("Validation_Errors", F.array_join(F.transform("violations", lambda v: v["message"]), "; "))


# --- duplicates and order --------------------------------------------------------------


def beyond_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows after the first of their key: no key is gathered in one task.

    The first row of each key is found by a map-side combined minimum of the order columns and,
    among rows equal in them, the row's place in the table (``session.placed``), so exactly one
    row of each key is left out. Rows are then compared with it.
    """
    rows = session.placed(df)
    joined_key = values.group_key(
        F.to_json(
            F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(key)]), {"ignoreNullFields": "false"}
        )
    )
    rank = F.struct(*[F.col(o) for o in order], F.col("_place"))
    firsts = rows.select(joined_key.alias("key"), rank.alias("_first")).groupBy("key").agg(
        F.min("_first").alias("_first"), F.count("*").alias("_rows")
    )
    repeated = session.stage(firsts.filter("_rows > 1"), "firsts")
    flagged = keyed.attach_by_key(rows, joined_key, repeated, ["_first"], weight="_rows")
    return flagged.filter(F.col("_first").isNotNull() & (rank > F.col("_first"))).select(*df.columns)


def risk_rank(risk: Column | str = "risk_level") -> Column:
    c = F.col(risk) if isinstance(risk, str) else risk
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def prioritize(rules: DataFrame, how: str, position: str) -> DataFrame:
    """``high_first``: by risk, then position. ``balanced``: high, medium, low in turn.

    Balanced numbering counts the rules of each risk in order with a range
    shuffle, so that the few risk levels do not become three huge tasks.
    """
    if how == "high_first":
        return rules.orderBy(risk_rank(), position)
    if how == "balanced":
        return round_robin(rules, "risk_level", position).orderBy("turn", risk_rank()).drop("turn")
    return rules


def round_robin(rules: DataFrame, group: str, position: str) -> DataFrame:
    """Adds ``turn``: the row's place (from 1) within its group by position."""
    numbered = load.assign_batches(rules, [group, position], 1).drop("batch_num")
    starts = numbered.groupBy(F.col(group).alias("_g")).agg(F.min("row_index").alias("_start"))
    # Staged, so that the planner knows how small one row per group is.
    starts = session.stage(starts, "starts")
    joined = numbered.join(starts, F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*rules.columns, (F.col("row_index") - F.col("_start") + 1).alias("turn"))


def focus(rules: DataFrame, kind: str) -> DataFrame:
    """Rules to look at: all, high risk (medium when there is none), failed, or the top seven."""
    if kind == "all":
        return rules
    if kind == "failed":
        return rules.filter(F.col("risk_level").isin("high", "medium"))
    if kind == "high":
        high = rules.filter("risk_level = 'high'")
        return rules.filter("risk_level = 'medium'") if high.isEmpty() else high
    if kind == "top":
        return rules.orderBy(risk_rank(), F.desc(F.size("fields")), "rule_name").limit(7)
    raise ValueError(f"unknown focus: {kind}")


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct names in both one-column tables."""
    return left.intersect(right)


def only_in_first(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct names of the first one-column table that the second lacks."""
    return left.subtract(right)
