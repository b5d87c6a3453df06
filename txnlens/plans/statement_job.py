"""End-to-end batch job: statement files -> clean transactions -> metrics and advice.

Stages communicate through written tables under ``output_dir`` (a shared
folder on a cluster), which also cuts the lineage: a lost executor never
forces a re-parse of the statement files once the clean table is written.
The per-account results (category spending, overview, recommendations,
insights) come from one written ``level_totals`` table, so the clean table
is aggregated once for all of them; the chart tables come from the clean table.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import metrics as m
from ..operators import parse as ps
from ..operators import quality as qa
from ..operators import rules as r
from ..sources import files as fl


def default_account(path: Column) -> Column:
    """Account of a statement file: the path of its folder (``.../<account>/<statement>.pdf``)."""
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def decode_statements(spark: SparkSession, input_path: str, decoded_path: str, glob: str = "*",
                      decode_fn: Callable[[bytes], list[str]] = fl.decode_utf8_pages,
                      account_of: Callable[[Column], Column] = default_account, max_mb: float | None = None) -> DataFrame:
    """Decode every file once and write one row per file (path, account_id, modificationTime, length,
    status, text); the files that are not valid or not decoded have their status and no text."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(input_path))
    checked = files.withColumn("status", fl.file_status("path", "length", ".pdf", max_mb))
    decoded = fl.statement_text(fl.decode_files(checked, decode_fn)).withColumn("account_id", account_of(F.col("path")))
    decoded.write.mode("overwrite").parquet(decoded_path)
    return spark.read.schema(decoded.schema).parquet(decoded_path)


def ingest_statements(spark: SparkSession, input_path: str, work_dir: str, glob: str = "*",
                      decode_fn: Callable[[bytes], list[str]] = fl.decode_utf8_pages,
                      account_of: Callable[[Column], Column] = default_account,
                      max_mb: float | None = None, as_of: Column | None = None):
    """Files -> (status of every file, typed transactions).

    Files are decoded once and statements parsed once: the decoded files and the matches are written
    under ``work_dir`` and both results read from there.  Generic rows are dated by the file's
    modification time, so a repeated run gives the same rows.
    """
    decoded = decode_statements(spark, input_path, os.path.join(work_dir, "decoded_files"), glob, decode_fn, account_of, max_mb)
    ok = decoded.filter(F.col("status") == "ok")
    as_of = F.col("modificationTime") if as_of is None else as_of
    matched_path = os.path.join(work_dir, "statement_matches")
    ps.match_statements(ok, "path", as_of=as_of, carry=("account_id",)).write.mode("overwrite").parquet(matched_path)
    matches = spark.read.parquet(matched_path)
    parsed = ps.parse_status(ok, matches, "path").withColumnRenamed("status", "parsed")
    status = (decoded.select("path", "account_id", "length", "status").join(parsed, "path", "left")
              .select("path", "account_id", "length", F.coalesce("parsed", "status").alias("status"),
                      *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_transactions", "n_rejected")]))
    return status, ps.assemble_transactions(matches.filter("accepted").drop("accepted"))


# Results written from the clean table: name -> (clean, keys) -> DataFrame.
CHARTS = {
    "daily_spending": m.daily_spending,
    "monthly_spending": m.monthly_spending,
    "day_of_week_spending": m.day_of_week_spending,
    "hourly_pattern": m.hourly_pattern,
    "amount_histogram": m.amount_histogram,
    "merchant_stats": m.merchant_stats,
    "merchant_spending_trends": m.merchant_spending_trends,
}


def run_statement_job(spark: SparkSession, input_path: str, output_dir: str, keys: Sequence[str] = ("account_id",),
                      glob: str = "*", decode_fn: Callable[[bytes], list[str]] = fl.decode_utf8_pages,
                      account_of: Callable[[Column], Column] = default_account, max_mb: float | None = None,
                      files_per_month: int = 16) -> dict[str, str]:
    """Run the whole job; returns the written table paths.

    The clean table is written by (year, month), each month in at most ``files_per_month`` files dealt by account.
    """
    out = {name: os.path.join(output_dir, name) for name in (
        "statement_status", "transactions_clean", "validation", "rejected_amounts", "level_totals", "category_spending",
        "overview", "recommendations", "insights", "advice", *CHARTS)}
    status, txns = ingest_statements(spark, input_path, os.path.join(output_dir, "work"), glob, decode_fn, account_of, max_mb)
    status.write.mode("overwrite").parquet(out["statement_status"])
    cl.rejected_amounts(txns, keys).write.mode("overwrite").parquet(out["rejected_amounts"])
    clean = cl.clean_transactions(txns, keys, order_by=("path", "line_no"))
    (clean.repartition("year", "month", F.pmod(F.xxhash64(*keys) if keys else F.xxhash64("path"), F.lit(files_per_month)))
     .write.mode("overwrite").partitionBy("year", "month").parquet(out["transactions_clean"]))

    stored = spark.read.parquet(out["transactions_clean"])
    qa.validate_transactions(stored, keys).write.mode("overwrite").parquet(out["validation"])
    # one aggregate pass over the clean table for every level the results need;
    # the (much smaller) level table is written once and shared
    m.level_totals(stored, keys).write.mode("overwrite").parquet(out["level_totals"])
    levels = spark.read.parquet(out["level_totals"])
    m.category_spending_from_levels(levels, keys).write.mode("overwrite").parquet(out["category_spending"])
    m.overview_from_levels(levels, keys).write.mode("overwrite").parquet(out["overview"])
    r.recommendations_from_levels(levels, keys).write.mode("overwrite").parquet(out["recommendations"])
    r.insights_from_levels(levels, keys).write.mode("overwrite").parquet(out["insights"])
    r.format_advice(spark.read.parquet(out["insights"]), keys).write.mode("overwrite").parquet(out["advice"])
    for name, chart in CHARTS.items():
        chart(stored, keys).write.mode("overwrite").parquet(out[name])
    return out


def read_clean(spark: SparkSession, output_dir: str, start=None, end=None) -> DataFrame:
    """The stored clean table; date bounds prune ``year``/``month`` partitions
    and push the date filter into the Parquet scan."""
    df = spark.read.parquet(os.path.join(output_dir, "transactions_clean"))
    if start is not None:
        s = F.lit(start).cast("date")
        df = df.filter((F.col("year") > F.year(s)) | ((F.col("year") == F.year(s)) & (F.col("month") >= F.month(s))))
    if end is not None:
        e = F.lit(end).cast("date")
        df = df.filter((F.col("year") < F.year(e)) | ((F.col("year") == F.year(e)) & (F.col("month") <= F.month(e))))
    return m.filter_by_date_range(df, start, end)
