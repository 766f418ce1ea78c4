"""Run logs as entries, with levels, sources and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import values


def log_level(error_rate: Column) -> Column:
    return F.when(error_rate > 50, "ERROR").when(error_rate > 10, "WARNING").otherwise("INFO")


def log_source(file_name: Column) -> Column:
    lower = F.lower(file_name)
    return (
        F.when(file_name.contains("processing_summary") | file_name.contains("batch_processing"), "Data Operations")
        .when(lower.contains("validation"), "Validation")
        .when(lower.contains("mapping"), "Mapping")
        .when(lower.contains("unit"), "Unit Testing")
        .otherwise("System")
    )


def log_module(folder: Column) -> Column:
    lower = F.lower(folder)
    return (
        F.when(lower.contains("dataload"), "Data Loader")
        .when(lower.contains("validation"), "Validation")
        .when(lower.contains("mapping"), "Mapping")
        .when(lower.contains("unit"), "Unit Testing")
        .otherwise("System")
    )


def log_entries(logs: DataFrame, source: str | None = None, level: str | None = None) -> DataFrame:
    """Entries from log rows as ``sources.files.scan_run_logs`` gives them.

    Columns read: ``file_path``, ``timestamp``, ``operation``, ``object``, ``org``,
    ``error_rate``, ``batch_number``, ``records``, ``success``, ``errors``.
    """
    name = F.substring_index("file_path", "/", -1)
    folder = F.regexp_replace("file_path", r"/[^/]*$", "")

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("0"))

    message = F.when(
        name.contains("processing_summary"),
        F.concat(F.lit("Processed "), shown("records"), F.lit(" records: "), shown("success"), F.lit(" success, "), shown("errors"), F.lit(" errors")),
    ).otherwise(
        F.concat(
            F.lit("Batch "), F.coalesce(F.col("batch_number").cast("string"), F.lit("N/A")), F.lit(": "),
            shown("success"), F.lit(" success, "), shown("errors"), F.lit(" errors"),
        )
    )
    unknown = F.lit("Unknown")
    out = logs.select(
        "timestamp",
        log_level(F.coalesce("error_rate", F.lit(0.0))).alias("level"),
        log_source(name).alias("source"),
        log_module(folder).alias("module"),
        F.coalesce("operation", unknown).alias("operation"),
        F.coalesce("object", unknown).alias("object"),
        F.coalesce("org", unknown).alias("org"),
        message.alias("message"),
        "file_path",
    )
    if source is not None:
        out = out.filter(F.col("source") == source)
    if level is not None:
        out = out.filter(F.col("level") == level)
    return out


def recent_logs(entries: DataFrame, n: int = 200, tie: list[str] | None = None) -> DataFrame:
    """The ``n`` newest entries, newest first (a distributed top-k)."""
    return entries.orderBy(F.desc("timestamp"), *(tie or [])).limit(n)


def log_counts(entries: DataFrame) -> DataFrame:
    """Entries in total and per level, one row."""
    return entries.agg(
        F.count("*").alias("total_entries"),
        *[F.count_if(F.col("level") == v).alias(v.lower()) for v in ("INFO", "WARNING", "ERROR")],
    )


def error_severity(errors: DataFrame) -> DataFrame:
    """Errors in total and per severity, one row."""
    return errors.agg(
        F.count("*").alias("total_errors"),
        *[F.count_if(F.col("severity") == v).alias(f"{v.lower()}_severity") for v in ("High", "Medium", "Low")],
    )


def errors_by_type(errors: DataFrame) -> DataFrame:
    """(error_type, errors); a missing type counts as Unknown."""
    return errors.groupBy(F.coalesce("error_type", F.lit("Unknown")).alias("error_type")).agg(
        F.count("*").alias("errors")
    )


def log_sizes(files: DataFrame) -> DataFrame:
    """Adds the readable form of ``size_bytes``."""
    return files.withColumn("size_text", values.file_size_text("size_bytes"))
