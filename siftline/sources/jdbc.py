"""Database source and sink options."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from siftline.sources import sinks


@dataclass(frozen=True)
class Bounds:
    """Numeric column and range by which a read is split into parallel queries."""

    column: str
    lower: int
    upper: int
    partitions: int


def default_query(object_name: str) -> str:
    return f"SELECT * FROM stg.[{object_name}]"


def jdbc_options(url: str, query: str, bounds: Bounds | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options for one SELECT; anything else is refused."""
    text = query.strip().rstrip(";")
    if not re.match(r"(?i)^select\b", text) or ";" in text:
        raise ValueError("only a single SELECT statement can be run")
    options = {"url": url, "fetchsize": str(fetch_size)}
    if bounds is None:
        return options | {"query": text}
    return options | {
        "dbtable": f"({text}) q",
        "partitionColumn": bounds.column,
        "lowerBound": str(bounds.lower),
        "upperBound": str(bounds.upper),
        "numPartitions": str(bounds.partitions),
    }


def scan_jdbc(spark: SparkSession, url: str, query: str, bounds: Bounds | None = None, **extra: str) -> DataFrame:
    """Rows of a SELECT. With ``bounds`` the query is read in parallel."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, bounds), **extra).load()


def jdbc_write_options(
    url: str, table: str, mode: str, batch_size: int = 10_000, writers: int = 8, exists: bool | None = None
) -> tuple[str, dict[str, str]]:
    """(save mode, writer options) of a load mode; refused when the target must (not) be there.

    Without ``exists`` the state of the target is not known, and only the mode is checked.
    """
    sinks.check_mode(table, mode, mode != "create" if exists is None else exists)
    options = {"url": url, "dbtable": table, "batchsize": str(batch_size), "numPartitions": str(writers)}
    saved = {"create": "errorifexists", "append": "append"}.get(mode, "overwrite")
    return saved, options | ({"truncate": "true"} if mode in ("truncate", "delete") else {})


def table_exists(spark: SparkSession, url: str, table: str, **extra: str) -> bool:
    """Whether the database lets the table's columns be read."""
    try:
        spark.read.format("jdbc").options(url=url, dbtable=table, **extra).load()
        return True
    except (PySparkException, Py4JJavaError):
        return False


def write_jdbc(df: DataFrame, url: str, table: str, mode: str, **extra: str) -> None:
    exists = table_exists(df.sparkSession, url, table, **extra)
    save_mode, options = jdbc_write_options(url, table, mode, exists=exists)
    df.write.format("jdbc").mode(save_mode).options(**options, **extra).save()
