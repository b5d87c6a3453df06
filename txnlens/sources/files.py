"""File sources and sinks: statement files, page decoding, table load/save."""

from __future__ import annotations

import codecs
import logging
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from .json_arrays import load_json_array

logger = logging.getLogger(__name__)


def file_status(path: str = "path", length: str = "length", ext: str = ".pdf", max_mb: float | None = None) -> F.Column:
    """``wrong extension`` / ``too big`` / ``valid`` (1 MB = 1024 * 1024 bytes); no size limit unless one is set."""
    status = F.when(~F.lower(F.col(path)).endswith(ext), F.lit("File is not a PDF" if ext == ".pdf" else "wrong extension"))
    if max_mb is not None:
        status = status.when(F.col(length) > F.lit(max_mb * 1024 * 1024), F.lit("too big"))
    return status.otherwise(F.lit("valid"))


def scan_statement_files(spark: SparkSession, root: str, glob: str = "*", ext: str = ".pdf", max_mb: float | None = None,
                         recursive: bool = False, expected: DataFrame | None = None) -> DataFrame:
    """List candidate files with a status each; paths of ``expected`` (column
    ``path``) that are not there are ``missing``.  The file bytes are not read
    (only ``path``, ``length``, ``modificationTime`` are selected, and the
    binary source prunes ``content``)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", str(recursive).lower()).load(root))
    listed = files.select("path", "length", "modificationTime", file_status("path", "length", ext, max_mb).alias("status"))
    if expected is None:
        return listed
    absent = expected.select("path").distinct().join(listed, "path", "left_anti")
    return listed.unionByName(absent.withColumn("status", F.lit("missing")), allowMissingColumns=True)


DECODED = 1 << 20             # bytes decoded at a time, and page bytes handed on at a time


def decode_utf8_pages(content: bytes) -> Iterator[str]:
    """Default decoder: UTF-8 text, form feed = page break; pages come one by one."""
    decode, page = codecs.getincrementaldecoder("utf-8")().decode, []
    for at in range(0, max(len(content), 1), DECODED):
        *done, rest = decode(content[at:at + DECODED], at + DECODED >= len(content)).split("\f")
        for text in done:
            yield "".join((*page, text))
            page = []
        page.append(rest)
    yield "".join(page)


def decode_files(files: DataFrame, decode_fn: Callable[[bytes], Iterable[str]] = decode_utf8_pages) -> DataFrame:
    """Binary file rows -> one row per file ``(path, modificationTime, length, pages, status)``.

    ``decode_fn`` runs batch-wise in the Python workers (``mapInPandas``), once
    for each file whose ``status`` column (if there is one) is ``valid``; the
    other rows pass with their status and null pages.  A decode failure gives
    status ``failed: <error>``.  ``content`` is dropped right after decoding,
    and the pages of a file stay one array: joining them needs no shuffle.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pages, status = [], []
            for content, before in zip(pdf.pop("content"), pdf["status"]):
                decoded = None
                if before == "valid":
                    try:
                        decoded, before = list(decode_fn(bytes(content))), "ok"
                    except Exception as e:  # foreign decoder: record, don't fail the job
                        before = f"failed: {type(e).__name__}"
                pages.append(decoded)
                status.append(before)
            yield pdf.assign(pages=pages, status=status)

    status = F.col("status") if "status" in files.columns else F.lit("valid")
    src = files.select("path", "modificationTime", "length", status.alias("status"),
                       F.when(status == "valid", F.col("content")).alias("content"))
    return src.mapInPandas(run, "path string, modificationTime timestamp, length bigint, pages array<string>, status string")


def statement_text(decoded: DataFrame, separator: str = "\n") -> DataFrame:
    """``decode_files`` rows with ``text``: the file's pages joined in place (null where decoding failed)."""
    return decoded.withColumn("text", F.when(F.col("pages").isNotNull(), F.array_join("pages", separator, ""))).drop("pages")


def _page_batches(rows: Iterator[tuple[str, bytes | None, str]], decode_fn: Callable[[bytes], Iterable[str]],
                  limit: int = DECODED) -> Iterator[pa.RecordBatch]:
    """(path, content, status) -> record batches (path, page_no, text, status) of at most ``limit`` text bytes, or one page."""
    held: list[tuple] = []
    size = 0
    schema_ = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("text", pa.string()), ("status", pa.string())])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema_)], schema=schema_)

    for path, content, status in rows:
        number = 0
        if status == "valid":
            try:
                for text in decode_fn(content):
                    more = len(text.encode("utf-8", "surrogatepass"))
                    if held and size + more > limit:
                        yield batch()
                        held, size = [], 0
                    held.append((path, number, text, "ok"))
                    number, size = number + 1, size + more
                continue
            except Exception as e:  # foreign decoder: record, don't fail the job
                status = f"failed: {type(e).__name__}"
        held.append((path, number, None, status))
    if held:
        yield batch()


def read_statement_pages(files: DataFrame, decode_fn: Callable[[bytes], Iterable[str]] = decode_utf8_pages) -> DataFrame:
    """Binary file rows -> one row per page ``(path, page_no, text, status)``.

    ``decode_fn`` may yield its pages; they go on as Arrow batches while it runs, so a file's pages are never all in
    memory.  A file that does not decode is one row with its status and null text; if that shows only after some
    pages, the row follows them, numbered as the next page: drop the path's pages if a broken file is to count as none.
    """
    status = F.col("status") if "status" in files.columns else F.lit("valid")
    src = files.select("path", F.when(status == "valid", F.col("content")).alias("content"), status.alias("status"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                paths, contents, states = (b.column(c) for c in ("path", "content", "status"))
                for i in range(b.num_rows):              # one file's bytes at a time
                    yield paths[i].as_py(), contents[i].as_py(), states[i].as_py()

        yield from _page_batches(rows(), decode_fn)

    return src.mapInArrow(run, "path string, page_no int, text string, status string")


def load_table(spark: SparkSession, path: str, schema_ddl: str | T.StructType | None = None,
               json_array: bool = False) -> DataFrame:
    """csv (header) or json by extension; other -> ValueError.

    json is read as JSON lines, in parallel.  ``json_array`` reads files that hold one JSON array
    of objects each (``json_arrays.load_json_array``), in parallel as well.
    """
    low = path.lower().rstrip("/")
    if low.endswith(".json") and json_array:
        return load_json_array(spark, path, schema_ddl)
    reader = spark.read.schema(schema_ddl) if schema_ddl is not None else spark.read.option("inferSchema", "true")
    if low.endswith(".csv"):
        return reader.option("header", "true").csv(path)
    if low.endswith(".json"):
        return reader.json(path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file format: {path}")


def _write(df: DataFrame, path: str, fmt: str) -> None:
    w = df.write.mode("errorifexists")
    if fmt == "csv":
        w.option("header", "true").option("dateFormat", "yyyy-MM-dd") \
         .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").csv(path)
    elif fmt == "json":
        w.option("dateFormat", "yyyy-MM-dd").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").json(path)
    else:
        w.parquet(path)


def _rows_of(spark: SparkSession, path: str, fmt: str, schema_: T.StructType) -> int:
    """Rows of a written table, by a scan that reads the table's files."""
    if fmt == "csv":
        return spark.read.option("header", "true").schema(schema_).csv(path).count()
    return (spark.read.schema(schema_).json(path) if fmt == "json" else spark.read.parquet(path)).count()


def save_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> bool:
    """csv (header, no index) / json (JSON lines, ISO dates) / parquet; True on success, False (and logged) on failure.

    ``overwrite`` writes beside the table, compares the rows in the files with the rows written (counted while writing, by
    ``observe``), and only then puts the new folder in the old one's place; on a failure the old table stays as it
    was.  The swap is two renames: a reader between them finds no table, never half of one.  On stores whose rename copies,
    use a table format with commits.  ``errorifexists`` fails if there is a table.
    """
    spark, fmt = df.sparkSession, fmt.lower()
    path = path.rstrip("/")
    new, old = (f"{path}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    try:
        if fmt not in ("csv", "json", "parquet"):
            raise ValueError(f"Unsupported format: {fmt}")
        fs, at = _file_system(spark, path)
        before = fs.exists(at(path))
        if before and mode != "overwrite":
            raise FileExistsError(path)
        seen = Observation()
        _write(df.observe(seen, F.count(F.lit(1)).alias("n")), new, fmt)
        written = _rows_of(spark, new, fmt, df.schema)
        if seen.get["n"] != written:
            raise OSError(f"{written} of {seen.get['n']} rows are in the files")
        if before and not fs.rename(at(path), at(old)):
            raise OSError(f"can't move {path}")
        if not fs.rename(at(new), at(path)):
            if before:
                fs.rename(at(old), at(path))
            raise OSError(f"can't move {new}")
        if before:
            fs.delete(at(old), True)
        return True
    except Exception:
        logger.exception("save_table: %s was not saved", path)
        try:
            fs, at = _file_system(spark, new)
            fs.delete(at(new), True)
        except Exception:
            logger.exception("save_table: %s was not removed", new)
        return False


def _file_system(spark: SparkSession, path: str):
    """The path's file system, and what makes its path objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def export_clean_csv(clean: DataFrame, path: str) -> bool:
    return save_table(clean, path, "csv")


def sample_transactions(spark: SparkSession, start: str = "2024-01-01", end: str = "2024-03-31",
                        per_day: int = 1, seed: int = 42) -> DataFrame:
    """Synthetic daily transactions, amounts uniform in [100, 10000)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"),
                                                      F.expr("interval 1 day"))).alias("date"))
    rows = days.select("date", F.explode(F.sequence(F.lit(1), F.lit(per_day))).alias("k"))
    return rows.select("date", (F.rand(seed) * 9900 + 100).cast(schema.MONEY).alias("amount"))
