"""One JSON array of objects per file, read by many tasks.

The text source cuts a file into byte ranges and each range into fragments that end before a ``}``.
Whether that brace ends an object of the array depends on all text before it: on the number of quotes (is the brace
inside a string?) and on the depth of brackets.  Both are sums over the fragments before, so they are
found as prefix sums in two levels: a total per byte range (a few rows), then a running sum within each range.  The
fragments between two ends are one object; fragments of an object that crosses a range meet by its number.

Byte ranges are Spark's (``spark.sql.files.maxPartitionBytes``), so no task and no sort holds more than one.  A file's ranges are
added up in one window: a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = ("_path", "_block")


def _prefix(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over all earlier fragments of the file."""
    totals = rows.groupBy(*SPLIT).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*SPLIT, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*SPLIT).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum(value).over(within), F.lit(0))
    return rows.withColumn("_run", running).join(totals, list(SPLIT)).withColumn(out, F.col("_run") + F.col("_before")).drop(
        "_run", "_before")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def load_json_array(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Rows of the objects of the array in each file of ``path``, in the given schema.

    Without a schema one that fits all objects is found by a pass over them (no objects: no columns).

    Objects may hold nested objects and arrays, and strings with any signs.  As in Spark's JSON reader a field that is absent or
    does not fit is null, and an object that is no JSON is a row of nulls.  An empty array or file has no rows.
    """
    read = spark.read.option("lineSep", "}").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_place"), F.col("value").alias("_text"))
    # a quote after a backslash doesn't end a string; parts between quotes lie in turn outside and inside of strings
    rows = rows.withColumn("_parts", F.split(F.regexp_replace("_text", r"\\.", ""), '"', -1))
    odd = F.array_join(F.filter("_parts", lambda x, i: i % 2 == 1), "")
    even = F.array_join(F.filter("_parts", lambda x, i: i % 2 == 0), "")
    quotes = (F.size("_parts") - 1).cast("bigint")

    def depth(outside: Column) -> Column:
        return (_count(outside, "{[") - _count(outside, "]")).cast("bigint")

    rows = rows.select(*SPLIT, "_place", "_text", quotes.alias("_quotes"), depth(even).alias("_even"), depth(odd).alias("_odd"))
    rows = _prefix(rows, "_quotes", "_quoted")
    inside = F.col("_quoted") % 2 == 1                       # the fragment starts inside of a string
    brace = (F.col("_quoted") + F.col("_quotes")) % 2 == 0       # the brace at its end is no part of a string
    rows = rows.withColumn("_brace", brace).withColumn(
        "_step", F.when(inside, F.col("_odd")).otherwise(F.col("_even")) - F.col("_brace").cast("int"))
    rows = _prefix(rows, "_step", "_depth")
    ends = F.col("_brace") & (F.col("_depth") + F.col("_step") == 1)
    rows = _prefix(rows.withColumn("_ends", ends.cast("bigint")), "_ends", "_object")
    objects = rows.groupBy("_path", "_object").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_place", "_text"))).alias("_fragments"), F.max("_ends").alias("_whole"))
    text = F.array_join(F.transform("_fragments", lambda x: x["_text"]), "}")
    # before the first object stands the bracket, before each other one a comma
    body = F.concat(F.regexp_replace(text, r"^[\s\x{FEFF}]*[\[,]\s*", ""), F.lit("}"))
    bodies = objects.filter("_whole = 1").select(body.alias("_body"))
    if schema is None:
        found = bodies.agg(F.schema_of_variant_agg(F.try_parse_json("_body"))).first()[0]
        schema = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING") if found.startswith("OBJECT<") else T.StructType([])
    parsed = bodies.select(F.from_json("_body", schema, {
        "dateFormat": "yyyy-MM-dd", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}).alias("_row"))
    return parsed.select("_row.*")
