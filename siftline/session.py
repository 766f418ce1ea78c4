"""Session defaults and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that is broadcast after it has been measured.
BROADCAST_BYTES = 32 * 1024 * 1024


def tune(spark: SparkSession) -> None:
    """Keep wide check projections compiled.

    The JVM does not compile methods above 8000 bytes of bytecode, and a frame
    with a few dozen checks easily makes one such whole-stage method, which then
    runs interpreted. Below this limit Spark uses the same generated expressions
    split into small methods.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def build_session(app: str = "siftline", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Frames with many checks are built from thousands of Column calls; do not
        # record a Python call site for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    tune(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's checkpoint folder, if it names one.

    Only a local session without that setting (as in a unit test) gets a folder of
    its own; on a cluster executors would each write to a disk that others cannot see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="siftline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to recompute when an executor is lost, and its
    file size is known to the planner, so later joins against it are sized from
    facts instead of guesses.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftline-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    tune(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Plan nodes that leave a row of a file the row that it is.
_ROW_KEEPING = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def from_files(df: DataFrame) -> bool:
    """Whether the rows come straight from files: projected and filtered at most."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in _ROW_KEEPING:
        if node.nodeName() == "LogicalRelation":
            return True
        node = node.children().apply(0)
    return False


def placed(df: DataFrame, name: str = "_place") -> DataFrame:
    """The rows with the place where they stand: (file, row of the file).

    Equal rows have different places, places are the same in every run and on every retry, and their
    order is the order of the table. Rows that do not come straight from files that number their rows
    (a join, an aggregate, text files) are staged first and have the places of the staged files.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if from_files(df):
        try:
            return df.select("*", place.alias(name))
        except AnalysisException:  # the format does not number rows
            pass
    return stage(df, "placed").select("*", place.alias(name))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder of any file system that Spark can write."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder and what it holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Removes this application's staged tables; results that read them must be written before."""
    remove(spark, f"{shared_dir(spark)}/siftline-{spark.sparkContext.applicationId}")


def spread(df: DataFrame) -> DataFrame:
    """A table scan over all cores when it has fewer splits than there are cores.

    For work that costs far more per row than moving the row (many patterns on
    long texts). A large input has more splits than cores and is left as it is.
    Meant for plain scans: a frame with shuffles would be run to count its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def measured_bytes(staged: DataFrame, columns: list[str]) -> tuple[int, int]:
    """(rows, bytes of text form) of a staged table, for broadcast decisions."""
    size = F.lit(0).cast("long")
    for name in columns:
        size = size + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 16
    row = staged.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def content_hash(df: DataFrame) -> Column:
    """A hash of the whole row; maps, which cannot be hashed, by their JSON text."""
    parts = [F.to_json(F.struct(sql_column(c))) if "map<" in kind else sql_column(c) for c, kind in df.dtypes]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def sql_column(name: str) -> Column:
    return F.col(sql_name(name))


def bounded_collect(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that holds metadata; refuse one that is not small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; this input must be metadata, not data")
    return rows


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sql_text(value: str) -> str:
    """A Python string as a Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    """A column name as a Spark SQL identifier."""
    return "`" + name.replace("`", "``") + "`"
