"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows hashed by entity stay in place for joins on (entity, value).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A threshold counts compressed bytes of files and shuffles, which a broadcast holds many times over, on the driver too.
    # Fixed tables are below it by far; tables that grow with the input are shuffled.
    "spark.sql.autoBroadcastJoinThreshold": "64k",
    # A task with a dozen windows sorts its rows as often, each time many times larger than their compressed shuffle bytes.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # A join whose other side is at most so large in every partition looks rows up instead of sorting both sides; larger ones are sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "8m",
    # Fused methods beyond HotSpot's limit are never compiled; let Spark split them instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Input rows of a partition, about: a task with a dozen sorts or windows holds its rows as often.
TASK_ROWS = 50_000


def configure(spark: SparkSession, rows: int = 0) -> SparkSession:
    """Apply the runtime settings every operator here relies on, for an input of so many rows.

    Spark merges small partitions of a shuffle but splits no large ones, so a
    shuffle begins with a number that grows with the input.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    return spark


def local_session(cores: str = "8", app: str = "accesslens", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("ACCESSLENS_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        # Capturing the Python call site of every expression costs more than planning it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local session, whose tasks share the driver's disk, gets a private
    folder where none is set; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="accesslens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, folder: str) -> str:
    """What a folder of tables holds: names, sizes and times of change, one level deep."""
    target, files = _file_system(spark, folder)
    if not files.exists(target):
        return ""
    return "|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files.listStatus(target)))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables."""
    target, files = _file_system(spark, folder)
    files.delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; call it when its results are stored elsewhere."""
    target, files = _file_system(spark, f"{shared_folder(spark)}/accesslens/{spark.sparkContext.applicationId}")
    files.delete(target, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, unique to this application and call."""
    return f"{shared_folder(spark)}/accesslens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:10]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back.

    The copy survives lost executors, and values that depend on how rows were
    laid out (partition numbers) are fixed once for every later reader.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
