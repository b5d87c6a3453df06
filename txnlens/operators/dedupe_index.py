"""Near-duplicate removal over arriving batches, against a stored index of keys.

The index holds a 128-bit digest of the key columns (``keys + subset``) of every row kept so far, with its batch: a table
partitioned by batch, bucketed and sorted by the digest, so that a batch meets it by a sort-merge anti-join that shuffles the
batch only.  A batch's rows are deduplicated among themselves, then against earlier batches.

Batches are numbered in the order they arrive, and a batch looks only at batches with a smaller number; it replaces its own part of the
index.  So a repeated batch (a retry after a lost driver, or a replay) gives the same rows and leaves the same index.
Batches that are run in order give together the keys that one run over all rows gives; of equal rows, that of the first
batch stays.  Null key values compare equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path
from .clean import NEAR_DUP_SUBSET, dedupe_near

BATCH, DIGEST = "batch_id", ("key_x", "key_y")


def key_digest(columns: Sequence[str]) -> dict[str, Column]:
    """Two 64-bit hashes of the columns' values and of which of them are null."""
    parts = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return dict(zip(DIGEST, (F.xxhash64(*parts), F.xxhash64(F.lit("again"), *parts)), strict=True))


def index_table(spark: SparkSession, path: str, buckets: int = 64) -> str:
    """Name of the index at ``path`` (its name is made of the whole path), made if it isn't there.

    A session that doesn't know the table yet finds the batches that others have stored.
    """
    name = f"dedupe_index_{hashlib.sha256(path.rstrip('/').encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(name):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
        columns = ", ".join(f"{c} BIGINT" for c in (*DIGEST, BATCH))
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({BATCH}) "
                  f"CLUSTERED BY ({', '.join(DIGEST)}) SORTED BY ({', '.join(DIGEST)}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
        spark.catalog.recoverPartitions(name)
    return name


def dedupe_batch(df: DataFrame, index_path: str, batch_id: int, keys: Sequence[str] = (), subset: Sequence[str] = NEAR_DUP_SUBSET,
                 order_by: Sequence[str] = ("line_no",), buckets: int = 64) -> DataFrame:
    """The batch's rows that no earlier batch and no earlier row of this one has; their keys are stored.

    The index part is written by this call; the rows returned depend on earlier batches alone, whatever is stored later
    for this one.  ``buckets`` counts only when the index is made.
    """
    spark = df.sparkSession
    group = [*keys, *[c for c in subset if c not in keys]]
    name = index_table(spark, index_path, buckets)
    known = spark.table(name).filter(F.col(BATCH) < batch_id).select(*DIGEST)
    fresh = dedupe_near(df, keys, subset, order_by).withColumns(key_digest(group))
    fresh = fresh.join(known.hint("merge"), list(DIGEST), "left_anti")
    spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({BATCH} = {int(batch_id)})")
    remove_path(spark, f"{index_path.rstrip('/')}/{BATCH}={int(batch_id)}")      # the table is external: its files stay
    fresh.select(*DIGEST, F.lit(int(batch_id)).cast("bigint").alias(BATCH)).write.mode("append").insertInto(name)
    return fresh.select(*df.columns)
