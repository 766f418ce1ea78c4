"""Writing tables and split results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siftline import session

SPLIT_ABOVE = 900_000
ROWS_PER_FILE = 500_000
#: Cells come back as they were: quotes are doubled, white space stays.
_TEXT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
MODES = ("create", "replace", "append", "truncate", "delete")


def check_mode(table: str, mode: str, exists: bool) -> None:
    """Refuses a load that the state of the target does not allow, for tables of any kind."""
    if mode not in MODES:
        raise ValueError(f"unknown load mode: {mode}")
    if mode == "create" and exists:
        raise ValueError(f"table {table} already exists")
    if mode == "append" and not exists:
        raise ValueError(f"table {table} does not exist")


def load_table(df: DataFrame, table: str, mode: str) -> None:
    """``create`` (must not exist), ``replace``, ``append`` (must exist), ``truncate`` / ``delete`` (keep the schema).

    What replaces a table is written beside it, counted, and takes its place by a change of names: the
    table is whole before and after, and ``df`` may read the table that it replaces.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    check_mode(table, mode, exists)
    if mode == "append":
        df.select(*spark.table(table).columns).write.mode("append").insertInto(table)
    elif not exists:
        df.write.mode("errorifexists").saveAsTable(table)
    else:
        _swap(df, table, keep_schema=mode != "replace")


def _swap(df: DataFrame, table: str, keep_schema: bool) -> None:
    spark = df.sparkSession
    new, old = f"{table}__new", f"{table}__old"
    for left_over in (new, old):  # of a load that was ended half-way
        spark.sql(f"DROP TABLE IF EXISTS {left_over}")
    written = Observation("load")
    counted = df.observe(written, F.count("*").alias("rows"))
    if keep_schema:
        spark.sql(f"CREATE TABLE {new} LIKE {table}")
        counted.select(*spark.table(table).columns).write.mode("append").insertInto(new)
    else:
        counted.write.mode("errorifexists").saveAsTable(new)
    found = spark.table(new).count()
    if found != written.get["rows"]:
        spark.sql(f"DROP TABLE {new}")
        raise RuntimeError(f"{table}: {found} rows arrived of {written.get['rows']}; the table is as it was")
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
    spark.sql(f"DROP TABLE {old}")
    spark.catalog.refreshTable(table)


def verify_load(target: DataFrame, expected: DataFrame) -> DataFrame:
    """Row counts of target and source and whether they agree, one row."""
    both = target.select(F.lit(1).alias("t"), F.lit(0).alias("e")).unionAll(
        expected.select(F.lit(0).alias("t"), F.lit(1).alias("e"))
    )
    counts = both.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("loaded_rows"), F.coalesce(F.sum("e"), F.lit(0)).alias("expected_rows"))
    return counts.withColumn("complete", F.col("loaded_rows") == F.col("expected_rows"))


def split_write(df: DataFrame, path: str, above: int = SPLIT_ABOVE, per_file: int = ROWS_PER_FILE, fmt: str = "csv") -> None:
    """Files of at most ``per_file`` rows; up to ``above`` rows go to a single file.

    The rows are written once, in parallel, and counted as they are written. Only a result of at most
    ``above`` rows that came out in several files is read again and gathered in one.
    """
    spark = df.sparkSession
    written = Observation("split-write")
    writer = df.observe(written, F.count("*").alias("rows")).write.mode("errorifexists").options(**_TEXT)
    writer.option("maxRecordsPerFile", per_file).format(fmt).save(path)
    if written.get["rows"] > above:
        return
    reader = spark.read.options(**_TEXT)
    if fmt == "csv":
        reader = reader.option("multiLine", True)
    back = reader.schema(", ".join(f"{session.sql_name(c)} STRING" for c in df.columns) if fmt == "csv" else df.schema).format(fmt).load(path)
    if len(back.inputFiles()) > 1:
        back.coalesce(1).write.mode("errorifexists").options(**_TEXT).format(fmt).save(f"{path}__one")
        session.remove(spark, path)
        session.move(spark, f"{path}__one", path)


def write_split(checked: DataFrame, path: str, fmt: str = "csv", plain: bool = True) -> None:
    """Valid rows to ``<path>/valid``, the others to ``<path>/invalid``.

    One partitioned write: the checks run once and nothing is copied before. A side without rows gets
    a file with the header.
    """
    spark = checked.sparkSession
    valid = F.coalesce(F.col("is_valid"), F.lit(False))
    out = checked.withColumn("_side", F.when(valid, "valid").otherwise("invalid"))
    out = out.drop(*(["is_valid", "violations", "error_count"] if plain else ["is_valid"]))
    if not plain and "violations" in out.columns and fmt == "csv":
        out = out.withColumn("violations", F.to_json("violations"))
    sides = Observation("write-split")
    counted = out.observe(sides, F.count_if(F.col("_side") == "valid").alias("valid"), F.count_if(F.col("_side") == "invalid").alias("invalid"))
    counted.write.mode("errorifexists").options(**_TEXT).partitionBy("_side").format(fmt).save(path)
    header = spark.createDataFrame([], out.drop("_side").schema).coalesce(1)
    for side in ("valid", "invalid"):
        if sides.get[side]:
            session.move(spark, f"{path}/_side={side}", f"{path}/{side}")
        else:
            header.write.mode("errorifexists").options(**_TEXT).format(fmt).save(f"{path}/{side}")
