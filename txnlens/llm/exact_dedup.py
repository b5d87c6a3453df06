"""Exact deduplication against a persistent digest index, bucketed and sorted by hash.

The index is a table of one row per distinct text seen so far: digest, keep_id, n_chars, batch.
A batch is grouped by digest, anti-joined with the index bucket by bucket (both sides are
distributed and sorted by digest, the index is neither shuffled nor sorted again) and its new
texts are appended.  Only digests move; texts never leave the scan.

A batch that comes again under its name (a job restarted after its append, or in the midst of it)
gets the same answer again: its own rows in the index count as not seen, and only those that are
not there yet are appended.

Texts are equal if they are identical after deleting blanks ([\\x20\\x09-\\x0D]); null counts as
empty.  Of equal rows in a batch the one with most code points, then the smallest id (null last)
stays; of rows that are wholly alike, one.  A text that the index holds already keeps nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_path, write

BUCKETS = 32             # of an index at least
ROWS_PER_BUCKET = 4_000_000
BLANKS = " \t\n\x0b\x0c\r"


def digest(text):
    """SHA-256 of the text without blanks."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256))


@dataclass
class DigestIndex:
    """A bucketed table at ``path``, known to the session's catalog as ``name``; choose ``buckets`` for the rows it will hold."""

    spark: SparkSession
    path: str
    id_type: str
    buckets: int = BUCKETS

    @property
    def name(self) -> str:
        return "digests_" + hashlib.sha256(self.path.rstrip("/").encode()).hexdigest()[:32]

    def open(self) -> DigestIndex:
        """Make the table, or find the one that an earlier session left at ``path``."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {self.id_type}, n_chars INT, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self

    def close(self) -> None:
        """Forget the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add rows; each bucket is written sorted, by one task."""
        (rows.select("digest", "keep_id", "n_chars", "batch").repartition(self.buckets, "digest").write
         .format("parquet").mode("append").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"),
                       F.coalesce(F.char_length(text), F.lit(0)).alias("n_chars"))


def dedup_batch(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate ``docs`` against the other batches of ``index`` and append what is new; a repeat of ``batch`` changes nothing.

    Returns a row per row of ``docs``: doc_id, keep_id, group_size (equal rows of the batch), kept,
    text_sha256, n_chars, n_alike (rows of the batch alike in id, digest and n_chars).
    """
    alike = write(_keyed(docs, id_col, text_col).groupBy("doc_id", "digest", "n_chars")
                  .agg(F.count("*").alias("n_alike")), "digests")
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    groups = alike.groupBy("digest").agg(best.alias("best"), F.sum("n_alike").alias("group_size"))
    groups = write(groups.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("n_chars"),
                                 "group_size"), "groups")
    others = index.table().filter(~F.col("batch").eqNullSafe(F.lit(batch)))
    known = write(groups.select("digest").join(others.select("digest", F.col("keep_id").alias("known_id")), "digest")
                  .groupBy("digest").agg(F.min("known_id").alias("known_id")), "known")
    new = groups.join(index.table(), "digest", "left_anti")
    index.append(new.withColumn("batch", F.lit(batch)))
    fate = write(groups.join(known.withColumn("is_known", F.lit(True)), "digest", "left")
                 .select("digest", F.when(F.col("is_known"), F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                         F.col("n_chars").alias("keep_chars"), F.col("is_known").isNull().alias("is_new"), "group_size"), "fate")
    first = (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    return (alike.join(fate, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_alike")))
            .select("doc_id", "keep_id", "group_size", (first & (F.col("copy") == 1)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "n_chars", "n_alike"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``dedup_batch`` of one batch against a fresh index, by default of a bucket per ``ROWS_PER_BUCKET`` rows and at least ``BUCKETS``."""
    spark = docs.sparkSession
    buckets = buckets or max(BUCKETS, -(-docs.count() // ROWS_PER_BUCKET))
    index = DigestIndex(spark, new_path(spark, "index"), docs.schema[id_col].dataType.simpleString(), buckets).open()
    try:
        return dedup_batch(docs, index, "first", id_col, text_col)
    finally:
        index.close()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``docs`` without the rows that ``dedup`` drops; columns as they were."""
    fate = dedup(docs, id_col, text_col, buckets)
    keys = write(fate.filter("kept").select("doc_id", "text_sha256", "n_chars", "n_alike"), "kept")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col(f"row.`{text_col}`").cast("string")
    hit = row.join(keys, F.col(f"row.`{id_col}`").eqNullSafe(keys["doc_id"])
                   & (F.lower(F.hex(digest(text))) == keys["text_sha256"])
                   & (F.coalesce(F.char_length(text), F.lit(0)) == keys["n_chars"]))
    once = hit.filter("n_alike > 1").dropDuplicates(["doc_id", "text_sha256", "n_chars"])
    return hit.filter("n_alike = 1").unionByName(once).select("row.*")
