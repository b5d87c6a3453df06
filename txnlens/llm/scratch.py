"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table survives lost executors and cuts lineage: a failed task is re-run from the
files, not from the whole job.  Folders made here are removed by ``clear(spark)``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; set here only on a local master that has none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="txnlens-llm-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def write(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet (``codec``: the session's by default) to a fresh shared folder, read back with the same columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that no one holds any more: its cleaner learns of them by a collection on the driver."""
    spark.sparkContext._jvm.System.gc()


def drop(table: DataFrame) -> None:
    """Remove a table that ``write`` made, once nothing reads it any more, and shuffles that no plan holds."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(file)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    tidy(spark)


def clear(spark: SparkSession) -> None:
    """Remove the folders made for this session. Results that still read them must be used before."""
    jvm = spark.sparkContext._jvm
    for path in _made.pop(spark.sparkContext.applicationId, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
