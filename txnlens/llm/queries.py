"""Queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, written and read back."""
    from .warc import page_of, round_trip

    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType

    def number(record_id):
        text = page_of(record_id)
        return F.when(text != "None", text).cast(kind)

    return round_trip(pages).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"), "url")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that align with a benchmark item."""
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels are learned where crc32(doc_id) mod 3 is not 1."""
    from . import quality
    from .scratch import write

    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    described = write(quality.describe(table(spark, sf_dir, "documents")), "statistics")
    model = quality.fit(described, table(spark, sf_dir, "labels").filter(fold != 1))
    return quality.score(described, model).select(
        "doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned where crc32(doc_id) mod 4 is not 2."""
    from . import langid

    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    return langid.predict(docs, langid.fit(docs.filter(fold != 2))).select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its text that stays, from a fresh digest index."""
    from .exact_dedup import dedup

    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    from .packing import pack, tokenize

    return pack(tokenize(table(spark, sf_dir, "documents")))


@query
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share."""
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its near-duplicate class, the class's size and the document's verified links."""
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "class_id", "class_size", F.col("representative").alias("kept"), "n_links")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learned where crc32(doc_id) mod 5 is not 0."""
    from . import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.fit(docs, labels.filter(fold != 0))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted",
        F.col("evidence.example").alias("evidence"))


@query
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and the class that its links reach."""
    from .jaccard_join import linked_sets

    return linked_sets(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with corpus-wide counts of linked ids."""
    from .token_alignment import link_statistics

    return link_statistics(table(spark, sf_dir, "documents"), groups="sha256").select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.col("groups").alias("groups_sha256"))


def stuttered(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the documents of op13's contract.

    With h = crc32 of the id as text and g = floor(h / 10), every word i >= a of a document with h % 10 = 0 and n > 0
    words becomes its word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    found = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, found))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("array_join(slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), "
                   "cast(ceil((n - a) / p) as int)))), 1, n), ' ')")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic word runs of every document (every tenth one made to repeat a part of itself)."""
    from .periodic_runs import periodic_runs

    found = periodic_runs(stuttered(table(spark, sf_dir, "documents")))
    # of two runs the one with the greater length / period, compared exactly; then start, then period
    ahead = ("x.length * y.period > y.length * x.period OR (x.length * y.period = y.length * x.period AND "
             "(x.start < y.start OR (x.start = y.start AND x.period < y.period)))")
    best = F.expr(f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (y, x) -> if({ahead}, x, y))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return (found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH keyed AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        ranked AS (
          SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM keyed
          WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked""",
}
