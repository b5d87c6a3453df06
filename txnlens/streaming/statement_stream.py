"""Incremental ingest: statement files arriving in a folder, parsed per micro-batch.

The same native parsing runs on each micro-batch (``foreachBatch``); every
batch writes its own ``batch_id=N`` folders in overwrite mode (``files``: a row per
file with its status; ``transactions``), so a replayed batch after a failure
rewrites the same rows (idempotent; generic rows are dated by the file).  Dedupe and the
metrics stay batch jobs over the accumulated table, because near-duplicates
may span batches.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import parse as ps
from ..plans.statement_job import default_account
from ..sources import files as fl

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def start_statement_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_dir: str,
                           decode_fn: Callable[[bytes], list[str]] = fl.decode_utf8_pages,
                           account_of: Callable[[Column], Column] = default_account,
                           available_now: bool = True, max_files_per_trigger: int = 1000,
                           max_mb: float | None = None) -> StreamingQuery:
    """Start the stream; ``available_now`` processes what is there and stops."""
    src = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).load(input_dir))

    def batch(df: DataFrame, batch_id: int) -> None:
        checked = df.withColumn("status", fl.file_status("path", "length", ".pdf", max_mb))
        decoded = fl.statement_text(fl.decode_files(checked, decode_fn)).withColumn("account_id", account_of(F.col("path")))
        files = os.path.join(output_dir, "files", f"batch_id={batch_id}")
        decoded.write.mode("overwrite").parquet(files)          # decoded once; status and rows read from here
        stored = df.sparkSession.read.schema(decoded.schema).parquet(files)
        rows = ps.parse_statements(stored.filter(F.col("status") == "ok"), "path", as_of=F.col("modificationTime"),
                                   carry=("account_id",))
        ps.assemble_transactions(rows).write.mode("overwrite").parquet(
            os.path.join(output_dir, "transactions", f"batch_id={batch_id}"))

    w = src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
