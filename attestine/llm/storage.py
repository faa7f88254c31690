"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from attestine.llm import kernels

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local folder only in local mode where none is configured (tests), else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestine-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Batches of whole texts that Python workers get hold 10,000 rows unless the session says otherwise: here `rows`, as both sides keep several."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def new_path(spark: SparkSession, label: str) -> str:
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor never re-runs what led to it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table written by materialize(), once nothing will read it again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if folder.rsplit("/", 1)[-1] in {p.rsplit("/", 1)[-1] for _, p in _written}:
            delete(spark, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that no DataFrame refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_driver(spark: SparkSession) -> None:
    """What earlier plans left on the driver: the JVM's garbage with the blocks that hang on it, and memory that Python has freed but not given back."""
    free_shuffles(spark)
    kernels.trim()


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            delete(spark, path)
