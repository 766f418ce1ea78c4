"""Batches, upsert outcomes and load reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import session
from siftline.functions import values
from siftline.operators import keyed

#: Rows that a range partition of ordered rows has at most, about.
ROWS_PER_RANGE = 1_000_000
#: monotonically_increasing_id keeps the row number of a partition in its low bits.
PARTITION_SHIFT = 33


def assign_batches(df: DataFrame, order_cols: list[str], batch_size: int = 10_000, partitions: int | None = None) -> DataFrame:
    """Adds ``row_index`` (from 0) and ``batch_num`` (from 1): contiguous batches in order.

    One range shuffle, into as many partitions as the rows ask for. Rows are numbered inside their range partition, the
    partition sizes (one row each) give the offsets, so no task ever sees all
    rows. Equal order keys are split by content, identical rows by position.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_RANGE))
    columns = [session.sql_column(c) for c in df.columns]
    tied = df.withColumn("_tie", session.content_hash(df)).withColumn("_spot", F.monotonically_increasing_id())
    order = [*order_cols, "_tie", "_spot"]
    placed = (
        tied.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select(*columns, F.monotonically_increasing_id().alias("_pos"))
    )
    # Staged once: the numbering must not be redone differently by a second pass.
    placed = session.stage(placed, "ordered")
    part = F.shiftright("_pos", PARTITION_SHIFT)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    rows = session.bounded_collect(sizes, n, "range partitions")
    offsets, total = [], 0
    for r in sorted(rows, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["_n"]
    offset = spark.createDataFrame(offsets, "_p long, _offset long")
    inside = F.col("_pos").bitwiseAND((1 << PARTITION_SHIFT) - 1)
    indexed = placed.join(F.broadcast(offset), part == F.col("_p")).withColumn("row_index", F.col("_offset") + inside)
    return indexed.select(
        *columns, "row_index", (F.floor(F.col("row_index") / batch_size) + 1).cast("long").alias("batch_num")
    )


def upsert(
    source: DataFrame, target: DataFrame, key: str, op: str = "upsert", carry: list[str] | None = None
) -> DataFrame:
    """New state of ``target`` together with what became of each source row.

    Columns: those of the target, ``in_source``, ``in_target``, ``outcome`` and
    ``error``. Insert of a key that exists, update of a key that does not, a key
    that repeats in the source, and a null key are error rows. ``key`` must be
    unique in the target. ``carry`` names source columns (such as the batch) to
    keep next to the outcome.
    """
    if op not in ("insert", "update", "upsert"):
        raise ValueError(f"unknown operation: {op}")
    if key.lower() == "id":
        raise ValueError("the record id cannot serve as external id")
    flagged = keyed.attach_duplicate_count(source, F.col(f"`{key}`"), "_copies", F.col(f"`{key}`").isNull())
    clean = flagged.filter(F.col("_copies").isNull() & F.col(f"`{key}`").isNotNull()).drop("_copies")
    refused = flagged.filter(F.col("_copies").isNotNull() | F.col(f"`{key}`").isNull())

    s = clean.select(*[F.col(f"`{c}`").alias(f"s_{c}") for c in source.columns], F.lit(True).alias("_s"))
    # Target rows without a key match nothing: they stay out of the join, where they would meet in one task.
    t = target.filter(F.col(f"`{key}`").isNotNull()).select(*[F.col(f"`{c}`").alias(f"t_{c}") for c in target.columns], F.lit(True).alias("_t"))
    joined = t.join(s, F.col(f"t_{key}") == F.col(f"s_{key}"), "full_outer")
    in_source, in_target = F.coalesce("_s", F.lit(False)), F.coalesce("_t", F.lit(False))
    outcome = (
        F.when(~in_source, "kept")
        .when(in_target & F.lit(op == "insert"), "error")
        .when(~in_target & F.lit(op == "update"), "error")
        .when(in_target, "updated")
        .otherwise("created")
    )
    error = (
        F.when(in_source & in_target & F.lit(op == "insert"), "DUPLICATE_VALUE: key already exists")
        .when(in_source & ~in_target & F.lit(op == "update"), "NOT_FOUND: key does not exist")
    )
    applies = outcome.isin("updated", "created")

    def merged(c: str) -> Column:
        old = F.col(f"t_{c}")
        if c not in source.columns:
            return old.alias(c)
        return F.when(applies, F.coalesce(F.col(f"s_{c}"), old)).when(in_target, old).otherwise(F.col(f"s_{c}")).alias(c)

    carry = carry or []
    done = joined.select(
        *[merged(c) for c in target.columns],
        *[F.col(f"s_{c}").alias(c) for c in carry],
        in_source.alias("in_source"),
        in_target.alias("in_target"),
        outcome.alias("outcome"),
        error.alias("error"),
    )
    types = {f.name: f.dataType for f in target.schema.fields}
    errors = refused.select(
        *[
            (F.col(f"`{c}`") if c in source.columns else F.lit(None)).cast(types[c]).alias(c) for c in target.columns
        ],
        *[F.col(f"`{c}`") for c in carry],
        F.lit(True).alias("in_source"),
        F.lit(False).alias("in_target"),
        F.lit("error").alias("outcome"),
        F.when(F.col(f"`{key}`").isNull(), "MISSING_VALUE: key is null")
        .otherwise("DUPLICATE_VALUE: key repeats in the source")
        .alias("error"),
    )
    keyless = target.filter(F.col(f"`{key}`").isNull()).select(
        *[F.col(f"`{c}`") for c in target.columns],
        *[F.lit(None).cast(source.schema[c].dataType).alias(c) for c in carry],
        F.lit(False).alias("in_source"),
        F.lit(True).alias("in_target"),
        F.lit("kept").alias("outcome"),
        F.lit(None).cast("string").alias("error"),
    )
    return done.unionByName(errors).unionByName(keyless)


def upsert_snapshot(merged: DataFrame) -> DataFrame:
    """The new target table of an ``upsert`` result."""
    kept = merged.filter(F.col("in_target") | F.col("outcome").isin("created", "updated"))
    return kept.drop("in_source", "in_target", "outcome", "error")


def upsert_outcomes(merged: DataFrame) -> DataFrame:
    """One row per source row of an ``upsert`` result."""
    return merged.filter("in_source").drop("in_source")


# --- results -----------------------------------------------------------------------------


def retry_rows(results: DataFrame, original: list[str]) -> DataFrame:
    """Failed rows with the original columns only."""
    return results.filter(~F.col("success")).select(*original)


def failed_rows(results: DataFrame, original: list[str]) -> DataFrame:
    """Failed rows with summary, full details, batch and operation."""
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    summary = F.when(F.size(errors) > 0, F.array_join(errors, "; ")).otherwise(F.lit("Unknown error"))
    return results.filter(~F.col("success")).select(
        *original,
        summary.alias("Error_Summary"),
        F.array_join(errors, " | ").alias("Full_Error_Details"),
        F.col("batch_num").alias("Batch_Number"),
        F.col("operation").alias("Failed_Operation"),
    )


def success_rows(results: DataFrame, original: list[str]) -> DataFrame:
    """Loaded rows with their record id, operation and batch."""
    return results.filter("success").select(
        *original,
        F.col("id").alias("Record_ID"),
        F.col("operation").alias("Operation"),
        F.col("batch_num").alias("Batch_Number"),
    )


def batch_results(results: DataFrame) -> DataFrame:
    """Records, successes and errors of every batch."""
    seconds = F.max("processing_time") if "processing_time" in results.columns else F.lit(0.0)
    return results.groupBy("batch_num").agg(
        F.count("*").alias("total_records"),
        F.count_if("success").alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        seconds.alias("processing_time"),
    )


def batch_report(batches: DataFrame) -> DataFrame:
    """Per batch rates and SUCCESS / PARTIAL / FAILED."""
    status = (
        F.when(F.col("error_count") == 0, "SUCCESS").when(F.col("success_count") > 0, "PARTIAL").otherwise("FAILED")
    )
    return batches.select(
        F.col("batch_num").alias("Batch_Number"),
        F.col("total_records").alias("Batch_Records"),
        F.col("success_count").alias("Batch_Success"),
        F.col("error_count").alias("Batch_Errors"),
        F.round("processing_time", 2).alias("Batch_Processing_Time_Seconds"),
        F.round(values.percent(F.col("success_count"), F.col("total_records")), 2).alias("Batch_Success_Rate_Percent"),
        F.round(values.percent(F.col("error_count"), F.col("total_records")), 2).alias("Batch_Error_Rate_Percent"),
        status.alias("Batch_Status"),
    )


def load_summary(batches: DataFrame, total_records: int | None = None, seconds: float = 0.0) -> DataFrame:
    """Totals and rates of a run over its batches, one row."""
    total = F.lit(total_records).cast("long") if total_records is not None else F.sum("total_records")
    sums = batches.agg(
        total.alias("Total_Records"),
        F.sum("success_count").alias("Total_Success"),
        F.sum("error_count").alias("Total_Errors"),
        F.count("*").alias("Total_Batches"),
    )
    return sums.select(
        "Total_Records",
        "Total_Success",
        "Total_Errors",
        (F.col("Total_Records") - F.col("Total_Success") - F.col("Total_Errors")).alias("Total_Unprocessed"),
        F.round(values.percent(F.col("Total_Success"), F.col("Total_Records")), 2).alias("Success_Rate_Percent"),
        F.round(values.percent(F.col("Total_Errors"), F.col("Total_Records")), 2).alias("Error_Rate_Percent"),
        "Total_Batches",
        F.lit(round(seconds, 2)).alias("Processing_Duration_Seconds"),
    )


def error_groups(failed: DataFrame, by_type: bool = True) -> DataFrame:
    """Failed rows per error type (the text before ``:``) or per full summary, most frequent first."""
    summary = F.col("Error_Summary")
    label = F.substring_index(summary, ":", 1) if by_type else summary
    return (
        failed.groupBy(label.alias("error_type"))
        .agg(F.count("*").alias("records"))
        .orderBy(F.desc("records"), "error_type")
    )


def outcome_level(success_rate: Column, failed: Column) -> Column:
    """Perfect without failures, then by success rate 90 / 70."""
    return (
        F.when(failed == 0, "Perfect").when(success_rate >= 90, "Great").when(success_rate >= 70, "Good").otherwise("Many failed")
    )


def in_batch_order(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Results of several batches as one table, sorted."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy(*order)
