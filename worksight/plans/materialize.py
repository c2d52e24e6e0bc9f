"""Cut lineage by writing a table to shared storage.

A written Parquet table survives the loss of executors and, unlike a
checkpoint or a cached frame, later reads still prune columns.
"""

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With this setting Spark removes the shuffle files of a query when the query ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writing = threading.Lock(), []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, where all tasks share one disk, may fall back to a
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="worksight-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files: what they wrote is read from now on, and no stage runs again.

    Else these files stay until the driver's garbage collection finds the plan, and the steps of a chain add up.
    Signals are built side by side, so the session's own setting returns with the last of them.
    """
    with _lock:
        _writing.append(_writing[0] if _writing else spark.conf.get(FILE_CLEANUP, "false"))
        spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            own = _writing.pop()
            if not _writing:
                spark.conf.set(FILE_CLEANUP, own)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads it back.

    Most of these tables are ids, keys and short texts, of which zstd stores a fifth less than Parquet's default.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/worksight/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete the files of materialised tables that no step reads any more."""
    for df in written:
        spark = df.sparkSession
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, rows: int, rows_per_task: int = 20_000) -> DataFrame:
    """Give a small table with costly rows enough partitions for all cores.

    File splits and adaptive coalescing go by bytes, which leaves a few
    megabytes in one task.  A table with enough rows is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows >= cores * rows_per_task:
        return df
    return df.repartition(max(1, min(cores, -(-rows // 2_000))))
