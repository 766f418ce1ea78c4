"""File sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import fixed

DESCRIBE_SCHEMA = (
    "name string, fields array<struct<name: string, label: string, type: string, length: int, nillable: boolean, "
    "`unique`: boolean, createable: boolean, updateable: boolean, calculated: boolean, autoNumber: boolean, "
    "externalId: boolean, referenceTo: array<string>, "
    "picklistValues: array<struct<value: string, active: boolean>>>>"
)
DETAILS_SCHEMA = (
    "`Field Name` string, `Label` string, `Type` string, `Required` boolean, `Unique` boolean, `Picklist Values` string"
)


def scan_csv(
    spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """CSV with a header; all columns are text unless a schema is given.

    Files are read in splits. ``multi_line=True`` is for quoted cells with line
    breaks and makes every file one task. Files without columns or rows are refused.
    ``encoding="ISO-8859-1"`` reads files that are not UTF-8.
    """
    reader = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
    )
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if not df.columns:
        raise ValueError(f"{path}: no columns")
    if df.isEmpty():
        raise ValueError(f"{path}: no data rows")
    return df


def catalog_from_describe(described: DataFrame) -> DataFrame:
    """Catalogue from object descriptions (one row per object)."""
    f = described.select(F.col("name").alias("object"), F.explode("fields").alias("f"))
    return f.select(
        "object",
        F.col("f.name").alias("name"),
        F.col("f.label").alias("label"),
        F.col("f.type").alias("type"),
        F.col("f.length").alias("length"),
        F.coalesce("f.nillable", F.lit(True)).alias("nillable"),
        F.coalesce("f.unique", F.lit(False)).alias("is_unique"),
        F.coalesce("f.createable", F.lit(False)).alias("createable"),
        F.coalesce("f.updateable", F.lit(False)).alias("updateable"),
        F.coalesce("f.calculated", F.lit(False)).alias("calculated"),
        F.coalesce("f.autoNumber", F.lit(False)).alias("auto_number"),
        F.coalesce("f.externalId", F.lit(False)).alias("external_id"),
        F.get("f.referenceTo", F.lit(0)).alias("reference_to"),
        F.filter("f.picklistValues", lambda p: F.coalesce(p["active"], F.lit(True))).alias("picklist"),
    )


def scan_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    return catalog_from_describe(spark.read.schema(DESCRIBE_SCHEMA).option("multiLine", True).json(path))


def split_picklist(c: Column) -> Column:
    """``a, b, c`` as an array of active values."""
    parts = F.filter(F.transform(F.split(c, ","), lambda v: F.trim(v)), lambda v: v != "")
    return F.transform(parts, lambda v: F.struct(v.alias("value"), F.lit(True).alias("active")))


def catalog_from_details(details: DataFrame, object_name: str) -> DataFrame:
    """Catalogue from a details table (Field Name, Label, Type, Required, Unique, Picklist Values)."""
    null = F.lit(None)
    return details.select(
        F.lit(object_name).alias("object"),
        F.col("Field Name").alias("name"),
        F.col("Label").alias("label"),
        F.col("Type").alias("type"),
        null.cast("int").alias("length"),
        (~F.coalesce(F.col("Required"), F.lit(False))).alias("nillable"),
        F.coalesce(F.col("Unique"), F.lit(False)).alias("is_unique"),
        *[null.cast("boolean").alias(n) for n in ("createable", "updateable", "calculated", "auto_number", "external_id")],
        null.cast("string").alias("reference_to"),
        split_picklist(F.col("Picklist Values")).alias("picklist"),
    )


def scan_catalog_csv(spark: SparkSession, path: str, object_name: str) -> DataFrame:
    return catalog_from_details(scan_csv(spark, path, DETAILS_SCHEMA, multi_line=True), object_name)


def catalog_to_details(catalog: DataFrame) -> DataFrame:
    """Details table of a catalogue: active values joined, Required = not nillable."""
    active = F.transform(F.filter("picklist", lambda p: F.coalesce(p["active"], F.lit(True))), lambda p: p["value"])
    return catalog.select(
        F.col("name").alias("Field Name"),
        F.col("label").alias("Label"),
        F.col("type").alias("Type"),
        (~F.coalesce(F.col("nillable"), F.lit(True))).alias("Required"),
        F.coalesce("is_unique", F.lit(False)).alias("Unique"),
        F.coalesce(F.array_join(active, ", "), F.lit("")).alias("Picklist Values"),
    )


def scan_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Both kinds of log file below a folder, as one table for ``logs.log_entries``."""

    def read(schema: str, pattern: str) -> DataFrame:
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern)
            .csv(path)
            .withColumn("file_path", F.col("_metadata.file_path"))
        )

    summary = read(fixed.SUMMARY_LOG_SCHEMA, "*processing_summary*.csv").select(
        "file_path",
        F.coalesce("Start_Time", "Log_Generated_At").alias("timestamp"),
        F.col("Operation").alias("operation"),
        F.col("Salesforce_Object").alias("object"),
        F.col("Salesforce_Org").alias("org"),
        F.col("Error_Rate_Percent").alias("error_rate"),
        F.lit(None).cast("int").alias("batch_number"),
        F.col("Total_Records").alias("records"),
        F.col("Total_Success").alias("success"),
        F.col("Total_Errors").alias("errors"),
    )
    null = F.lit(None)
    batches = read(fixed.BATCH_LOG_SCHEMA, "*batch_processing*.csv").select(
        "file_path",
        null.cast("timestamp").alias("timestamp"),
        *[null.cast("string").alias(n) for n in ("operation", "object", "org")],
        # The batch file has no overall rate, and its level is INFO without one.
        null.cast("double").alias("error_rate"),
        F.col("Batch_Number").alias("batch_number"),
        F.col("Batch_Records").alias("records"),
        F.col("Batch_Success").alias("success"),
        F.col("Batch_Errors").alias("errors"),
    )
    return summary.unionByName(batches)

