"""The target field catalogue as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import fixed, values

SCHEMA = (
    "object string, name string, label string, type string, length int, nillable boolean, is_unique boolean, "
    "createable boolean, updateable boolean, calculated boolean, auto_number boolean, external_id boolean, "
    "reference_to string, picklist array<struct<value: string, active: boolean>>"
)


def catalog_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A catalogue from a few hand-written rows; missing keys are null."""
    names = [f.name for f in spark.createDataFrame([], SCHEMA).schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)


def column_status() -> Column:
    """Status of a data column given its (left-joined) catalogue row."""
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    generated = flag("calculated") | flag("auto_number")
    return (
        F.when(F.col("name").isNull(), "not_found")
        .when(~flag("createable") & ~flag("updateable") & generated, "read_only")
        .when(~flag("createable") & ~flag("updateable"), "permission_issue")
        .when(generated, "read_only")
        .when(F.col("type").isin("address", "location"), "complex_type")
        .otherwise("valid")
    )


def classify_columns(columns: list[str], catalog: DataFrame, object_name: str | None = None) -> DataFrame:
    """(column, status) of every data column, names compared without case."""
    wanted = catalog if object_name is None else catalog.filter(F.col("object") == object_name)
    wanted = wanted.filter(F.lower("name").isin([c.lower() for c in columns])).withColumn("_key", F.lower("name"))
    listed = catalog.sparkSession.createDataFrame([(c, c.lower()) for c in columns], "column string, _key string")
    return listed.join(wanted, "_key", "left").select("column", column_status().alias("status"))


def drop_incompatible(df: DataFrame, catalog: DataFrame, object_name: str | None = None) -> DataFrame:
    """Only the columns that can be loaded; an error when none is left.

    Names that several objects of the catalogue have need ``object_name``; a column
    passes when one of the fields that its name fits can be loaded.
    """
    status = classify_columns(df.columns, catalog, object_name).filter("status = 'valid'")
    valid = {r["column"] for r in status.select("column").distinct().collect()}  # as many as columns at most
    kept = [c for c in df.columns if c in valid]
    if not kept:
        raise ValueError("no column can be loaded into the target")
    return df.select(*[F.col(f"`{c}`") for c in kept])


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Per object: field counts, weighted complexity and its level."""
    counts = catalog.groupBy("object").agg(
        F.count("*").alias("total_fields"),
        F.count_if(~F.coalesce(F.col("nillable"), F.lit(True))).alias("required_fields"),
        F.count_if(F.col("type").isin("picklist", "multipicklist")).alias("picklist_fields"),
        F.count_if(F.col("type") == "reference").alias("reference_fields"),
        F.count_if(F.col("name").endswith("__c")).alias("custom_fields"),
        F.count_if(F.coalesce(F.col("updateable"), F.lit(False))).alias("updateable_fields"),
    )
    score = sum((F.col(n) * F.lit(w) for n, w in fixed.COMPLEXITY_WEIGHTS.items()), F.lit(0.0))
    scored = counts.withColumn("complexity_score", F.round(score, 2))
    return scored.withColumn(
        "complexity_level", values.band(F.col("complexity_score"), fixed.COMPLEXITY_LEVELS, fixed.COMPLEXITY_LOWEST)
    )


def fields_by_type(catalog: DataFrame) -> DataFrame:
    """(object, type, fields)."""
    return catalog.groupBy("object", F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        F.count("*").alias("fields")
    )
