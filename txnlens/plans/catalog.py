"""Every operator as a job over the given tables: ``name -> fn(spark, sf_dir) -> DataFrame``.

Per-account results (``keys = ("account_id",)``) throughout; money leaves as
double (exact decimal sums cast once) so results compare across engines.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import clean as cl
from ..operators import dedupe_index as di
from ..operators import long_statements as ls
from ..operators import metrics as m
from ..operators import parse as ps
from ..operators import quality as q
from ..operators import rules as r
from ..operators import vocabulary as vo
from ..session import remove_path, scratch_path
from ..sources import files as fl
from ..sources import fixtures as fx

K = ("account_id",)
AS_OF = "2024-02-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def out(df: DataFrame) -> DataFrame:
    """Decimals -> double at the boundary (exact sums, one rounding)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def clean(spark, d):
    return cl.clean_transactions(fx.txn(spark, d), K)


def clean_big(spark, d):
    return cl.clean_transactions(fx.txn_big(spark, d), K)


def statements(spark, d):
    return ps.assemble_statement_text(fx.statement_pages(spark, d))


def _parsed_cols(df: DataFrame) -> DataFrame:
    return out(df.select("statement_id", "line_no", "datetime", "description", "amount",
                         "transaction_type", "app_source"))


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# --- 2.1 sources and sinks ---------------------------------------------------

@query
def read_statement_pages(spark, d):
    return fl.read_statement_pages(fx.statement_files(spark, d))


@query
def assemble_statement_text(spark, d):
    return statements(spark, d)


class _Stored:
    """A table that a query writes and reads back; its folder goes with the session's scratch."""

    made: list[str] = []

    @classmethod
    def path(cls, spark, name, ext):
        path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}{ext}")
        cls.made.append(path)
        return path


def clear_scratch(spark) -> None:
    """Remove the tables that ``load_table``, ``save_table`` and ``export_clean_csv`` have written."""
    while _Stored.made:
        remove_path(spark, _Stored.made.pop())


@query
def load_table(spark, d):
    path, t = _Stored.path(spark, "txn", ".csv"), out(fx.txn(spark, d))
    fl.save_table(t, path, "csv")
    return fl.load_table(spark, path, t.schema)


def _saved(saved: bool, path: str) -> None:
    if not saved:
        raise OSError(f"{path} was not saved")


@query
def save_table(spark, d):
    """The clean table put in the place of an older one, read back."""
    path, c = _Stored.path(spark, "clean", ".json"), out(clean(spark, d))
    _saved(fl.save_table(c.limit(0), path, "json"), path)
    _saved(fl.save_table(c, path, "json"), path)
    return fl.load_table(spark, path, c.schema)


@query
def export_clean_csv(spark, d):
    path, c = _Stored.path(spark, "export", ".csv"), out(clean(spark, d))
    _saved(fl.export_clean_csv(c, path), path)
    return fl.load_table(spark, path, c.schema)


JSON_TURN = "conv_id bigint, turn bigint, said struct<role: string, text: string>, words array<string>"


@query
def load_json_array(spark, d):
    """Conversation turns written as files of one JSON array each, read back; a row nests its text and its words."""
    c = fx.table(spark, d, "conversations")
    row = F.to_json(F.struct(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.struct("role", "text").alias("said"),
                             F.split("text", " ").alias("words")))
    path = _Stored.path(spark, "turns", ".json")
    # a file's rows in order: its bracket, its objects and the closing bracket
    def array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            lines = []
            for value in batch.column(0).to_pylist():
                lines.append(mark + value)
                mark = ", "
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == ", " else "[]"])], ["value"])

    c.select(row.alias("value")).mapInArrow(array_lines, "value string").write.text(path)
    read = fl.load_table(spark, path, JSON_TURN, json_array=True)
    return read.select("conv_id", "turn", "said.role", "said.text", F.array_join("words", "|").alias("words"))


# --- 2.2 parsing ---------------------------------------------------------------

@query
def detect_app_source(spark, d):
    return ps.detect_app_source(statements(spark, d))


@query
def split_statement_lines(spark, d):
    return ps.split_statement_lines(statements(spark, d))


def _parse_app(spark, d, app):
    st = statements(spark, d).filter(ps.detect_app("text") == app)
    return _parsed_cols(ps.parse_statements(st, app=app))


@query
def parse_paytm(spark, d):
    return _parse_app(spark, d, "paytm")


@query
def parse_gpay(spark, d):
    return _parse_app(spark, d, "gpay")


@query
def parse_phonepe(spark, d):
    return _parse_app(spark, d, "phonepe")


@query
def parse_generic(spark, d):
    return _parsed_cols(ps.parse_statements(statements(spark, d), app="generic", as_of=_as_of()))


@query
def parse_statements(spark, d):
    return _parsed_cols(ps.parse_statements(statements(spark, d), as_of=_as_of()))


@query
def assemble_transactions(spark, d):
    st = statements(spark, d).withColumn("account_id", F.expr(f"statement_id div {fx.STATEMENTS_PER_ACCOUNT}"))
    return out(ps.assemble_transactions(ps.parse_statements(st, as_of=_as_of(), carry=("account_id",))))


@query
def parse_status(spark, d):
    """Status of the statement files, which hold undecodable, blank and empty ones; every ninth amount is unreadable."""
    decoded = fl.statement_text(fl.decode_files(fx.statement_files(spark, d)))
    st = decoded.withColumn("text", F.regexp_replace("text", "₹([0-9]*9[.][0-9]*)", "₹,"))
    return ps.parse_status(st, ps.match_statements(st, "path", as_of=_as_of()), "path")


@query
def union_parsed(spark, d):
    """Rows of the layouts, each parsed by itself, as one table."""
    st = statements(spark, d).withColumn("_app", ps.detect_app("text"))
    parts = [ps.parse_statements(st.filter(F.col("_app") == app).drop("_app"), app=app, as_of=_as_of())
             for app in (*ps.PARSERS, schema.GENERIC_APP)]
    return _parsed_cols(functools.reduce(DataFrame.unionByName, parts))


@query
def parse_long_statements(spark, d):
    """Statements cut into blocks of 16 lines, each parsed by a task of its own."""
    return _parsed_cols(ls.parse_long_statements(statements(spark, d), as_of=_as_of(), block_lines=16))


# --- 2.3 projections -------------------------------------------------------------

@query
def abs_amount(spark, d):
    return out(cl.abs_amount(fx.txn_dirty(spark, d)).select("account_id", "line_no", "amount"))


def _texts(spark, d):
    """Descriptions, whole documents and whole conversation turns as one column."""
    docs, turns = fx.table(spark, d, "documents"), fx.table(spark, d, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    return (fx.txn_dirty(spark, d).select(F.lit("txn").alias("src"), F.col("line_no").cast("string").alias("id"), "description")
            .unionByName(docs.select(F.lit("doc").alias("src"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("description")))
            .unionByName(turns.select(F.lit("turn").alias("src"), key.alias("id"), F.col("text").alias("description"))))


@query
def clean_description(spark, d):
    return _texts(spark, d).select("src", "id", tx.clean_description("description").alias("description_clean"))


@query
def extract_merchant(spark, d):
    return _texts(spark, d).select("src", "id", tx.extract_merchant(tx.clean_description("description")).alias("merchant"))


@query
def categorize(spark, d):
    return _texts(spark, d).select("src", "id", tx.categorize(tx.clean_description("description")).alias("category"))


def vocabulary(spark, d):
    """Keyword rows from the benchmark's words of four letters and more and the names of parts; priorities repeat."""
    words = fx.table(spark, d, "benchmark").select(F.explode(F.split(tx.clean_description("text"), " ")).alias("keyword"))
    names = fx.table(spark, d, "part").select(F.lower("p_name").alias("keyword"))
    rows = words.filter(F.length("keyword") >= 4).unionByName(names).distinct()
    size = F.length("keyword")
    return rows.select((size % 7).alias("priority"), F.concat(F.lit("group "), size).alias("category"), "keyword")


@query
def categorize_by_table(spark, d):
    t = _texts(spark, d).select("src", "id", tx.clean_description("description").alias("description_clean"))
    return vo.categorize_by_table(t, vocabulary(spark, d)).select("src", "id", "category")


@query
def derive_time_features(spark, d):
    return cl.derive_time_features(fx.txn(spark, d)).select("line_no", "hour", "day_of_month", "is_weekend")


@query
def amount_range(spark, d):
    t = cl.abs_amount(fx.txn_big(spark, d))
    return out(t.select("account_id", "line_no", "amount", cl.amount_range("amount").alias("amount_range")))


@query
def month_year_key(spark, d):
    return fx.txn_big(spark, d).select("account_id", "line_no", sc.month_year_key("date").alias("month_year"))


@query
def day_name(spark, d):
    return fx.txn_big(spark, d).select("account_id", "line_no", sc.day_name("date").alias("day_name"))


@query
def typed_projection(spark, d):
    return out(clean_big(spark, d))


@query
def clean_transactions(spark, d):
    return out(clean(spark, d))


# --- 2.4 filters ------------------------------------------------------------------

@query
def filter_valid_amounts(spark, d):
    t = cl.filter_valid_amounts(cl.abs_amount(fx.txn_big(spark, d)))
    return out(t.select("account_id", "line_no", "amount"))


@query
def filter_by_type(spark, d):
    return out(m.filter_by_type(clean(spark, d), "debit").select("account_id", "line_no", "amount"))


@query
def filter_by_categories(spark, d):
    c = m.filter_by_categories(clean(spark, d), ["Food & Dining", "Groceries"])
    return out(c.select("account_id", "line_no", "category", "amount"))


@query
def filter_by_date_range(spark, d):
    c = m.filter_by_date_range(clean_big(spark, d), "1996-01-01", "1997-06-30")
    return out(c.select("account_id", "line_no", "date", "amount"))


@query
def filter_by_amount_range(spark, d):
    c = m.filter_by_amount_range(clean_big(spark, d), 1000, 5000)
    return out(c.select("account_id", "line_no", "amount"))


@query
def filter_by_merchants(spark, d):
    c = m.filter_by_merchants(clean(spark, d), ["Zomato", "Dmart", "Big"])
    return out(c.select("account_id", "line_no", "merchant", "amount"))


@query
def filter_small_debits(spark, d):
    return out(m.filter_small_debits(clean(spark, d)).select("account_id", "line_no", "amount"))


@query
def filter_weekend(spark, d):
    return out(m.filter_weekend(clean(spark, d)).select("account_id", "line_no", "amount"))


@query
def column_bounds(spark, d):
    return out(m.column_bounds(clean(spark, d), K))


@query
def distinct_values(spark, d):
    return m.distinct_values(clean(spark, d), "merchant", K)


# --- 2.5 joins ------------------------------------------------------------------------

@query
def merchant_frequency(spark, d):
    return clean(spark, d).select("account_id", "line_no", "merchant", "merchant_frequency")


@query
def semi_join_top_merchants(spark, d):
    return out(m.semi_join_top_merchants(clean_big(spark, d), K).select("account_id", "line_no", "merchant", "amount"))


@query
def reindex_weekdays(spark, d):
    c = m.with_calendar_keys(m.filter_by_type(clean(spark, d), "debit"))
    agg = c.groupBy(*K, "day_name").agg(F.sum("amount").alias("amount"))
    return out(m.reindex_weekdays(agg, K))


@query
def replace_small_levels(spark, d):
    """Categories that are small over all accounts, replaced in every account."""
    c = clean(spark, d)
    return m.replace_small_levels(c, "category", m.small_levels(c, "category")).select("account_id", "line_no", "category")


@query
def group_small_categories(spark, d):
    return m.group_small_categories(clean(spark, d), "merchant", K).select("account_id", "line_no", "merchant")


# --- 2.6 aggregations --------------------------------------------------------------------

@query
def overview_metrics(spark, d):
    return out(m.overview_metrics(clean(spark, d), K))


@query
def summary_stats(spark, d):
    return m.summary_long(clean(spark, d), K)


@query
def summary_maps(spark, d):
    """The summary as one row per account; maps as their entries by name."""
    s = m.summary_stats(clean(spark, d), K)
    maps = ("categories", "top_merchants", "transaction_types")

    def entries(c: str) -> F.Column:
        by_name = F.array_sort(F.map_entries(c))
        return F.array_join(F.transform(by_name, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")

    return out(s.withColumns({c: entries(c) for c in maps}))


@query
def category_spending(spark, d):
    return out(m.category_spending(clean(spark, d), K))


@query
def category_stats(spark, d):
    return out(m.category_stats(clean(spark, d), K, ["Food & Dining", "Groceries", "Transfer"]))


@query
def category_counts(spark, d):
    return m.category_counts(clean(spark, d), K)


@query
def transaction_type_counts(spark, d):
    return m.transaction_type_counts(clean(spark, d), K, 20, 200)


@query
def daily_spending(spark, d):
    return out(m.daily_spending(clean(spark, d), K, "2024-01-05", "2024-01-20"))


@query
def monthly_spending(spark, d):
    return out(m.monthly_spending(clean_big(spark, d), K))


@query
def day_of_week_spending(spark, d):
    return out(m.day_of_week_spending(clean(spark, d), K))


@query
def hourly_pattern(spark, d):
    return out(m.hourly_pattern(clean(spark, d), K))


@query
def amount_histogram(spark, d):
    return m.amount_histogram(clean_big(spark, d), K, 30)


@query
def top_merchants_by_count(spark, d):
    return m.top_merchants_by_count(clean(spark, d), K, 10)


@query
def merchant_stats(spark, d):
    return out(m.merchant_stats(clean_big(spark, d), K, 10))


@query
def merchant_spending_trends(spark, d):
    return out(m.merchant_spending_trends(clean_big(spark, d), K, 5))


@query
def weekend_vs_weekday(spark, d):
    return out(m.weekend_vs_weekday(clean(spark, d), K))


@query
def category_share(spark, d):
    return out(m.category_share(clean(spark, d), K))


@query
def spending_summary(spark, d):
    return m.spending_summary(clean_big(spark, d), K)


# --- 2.7 windows -------------------------------------------------------------------------------

@query
def dedupe_near(spark, d):
    t = cl.dedupe_near(fx.txn_dirty(spark, d), K)
    return out(t.select("account_id", "line_no", "date", "amount", "description", "transaction_type"))


@query
def dedupe_near_batches(spark, d):
    """Transactions in four batches by line number against a stored index; the second one arrives twice."""
    t = fx.txn_dirty(spark, d).select("account_id", "line_no", "date", "amount", "description", "transaction_type", "statement_id",
                                      "datetime", "app_source", "month", "year")
    bounds = t.agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi")).first()
    lo, span = bounds["lo"] or 0, (bounds["hi"] or 0) - (bounds["lo"] or 0) + 1
    index, kept = _Stored.path(spark, "dedupe-index", ""), _Stored.path(spark, "dedupe-kept", "")
    columns = ("account_id", "line_no", "date", "amount", "description", "transaction_type")
    for batch in (0, 1, 2, 1, 3):
        part = t.filter(F.expr(f"(line_no - {lo}) * 4 div {span}") == batch)
        fresh = di.dedupe_batch(part, index, batch, K, buckets=8)
        out(fresh.select(*columns)).write.mode("overwrite").parquet(f"{kept}/{di.BATCH}={batch}")
    return spark.read.parquet(kept).select(*columns)


@query
def recurring_merchants(spark, d):
    return m.recurring_merchants(clean(spark, d), K)


@query
def pct_change(spark, d):
    return out(m.monthly_category_change(clean_big(spark, d), K))


@query
def pct_change_calendar(spark, d):
    return out(m.calendar_category_change(clean_big(spark, d), K))


# --- 2.8 sorts and top-k -------------------------------------------------------------------------

@query
def sort_by_metric(spark, d):
    order = [F.col("amount"), F.col("category")]
    place = F.row_number().over(Window.partitionBy("account_id").orderBy(*order))
    spent = m.category_spending(clean(spark, d), K).withColumn("place", place)
    return out(spent.orderBy("account_id", *order))


@query
def top_k(spark, d):
    t = m.merchant_totals(clean_big(spark, d), K)
    return out(m.top_k(t, 10, [F.col("total_amount").desc(), F.col("account_id"), F.col("merchant")]))


@query
def top_category(spark, d):
    return out(m.top_category(clean(spark, d), K))


# --- 2.9 set operations ----------------------------------------------------------------------------

@query
def distinct_rows(spark, d):
    t = fx.txn_dirty(spark, d).drop("line_no", "statement_id")
    return out(cl.distinct_rows(t))


# --- 2.10 scalar functions ---------------------------------------------------------------------------

TOKEN = "₹?[0-9][0-9,.]*"


@query
def to_amount(spark, d):
    docs = fx.table(spark, d, "documents")
    toks = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("pos", "token"))
    return toks.select("doc_id", "pos", "token", sc.to_amount("token").alias("amount"))


@query
def extract_numbers(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(tx.extract_numbers("text")).alias("pos", "number"))


@query
def clean_text(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", tx.clean_text("text").alias("text_clean"))


DATE_RENDER = ("d/M/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "MM/dd/yyyy")


@query
def parse_flexible_date(spark, d):
    o = fx.table(spark, d, "orders")
    k = (F.col("o_orderkey") % 6).cast("int")
    rendered = F.coalesce(*[F.when(k == i, F.date_format("o_orderdate", f)) for i, f in enumerate(DATE_RENDER)])
    return o.select("o_orderkey", sc.parse_flexible_date(rendered).alias("parsed_date"))


@query
def date_range_label(spark, d):
    b = m.column_bounds(clean_big(spark, d), K)
    return b.select(*K, "min_date", "max_date", sc.date_range_label("min_date", "max_date").alias("label"))


@query
def hash_sensitive(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", sc.hash_sensitive("c_name").alias("name_hash"))


@query
def mask_account(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select("c_custkey", sc.mask_account(F.col("c_custkey").cast("string")).alias("key_masked"),
                    sc.mask_account("c_name").alias("name_masked"))


@query
def cut_text(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", tx.cut_text("text", 100).alias("head100"),
                       tx.cut_text("text", 500, "...").alias("head500"))


# --- 2.11 data quality ------------------------------------------------------------------------------

@query
def validate_transactions(spark, d):
    v = q.validate_transactions(fx.txn_dirty(spark, d), K)
    return out(v.withColumn("missing_columns", F.array_join("missing_columns", ","))
               .withColumn("high_null_columns", F.array_join("high_null_columns", ",")))


@query
def validate_on_write(spark, d):
    """One row for the whole table, gathered while it is written; the descriptions column is absent."""
    t = fx.txn_dirty(spark, d).drop("description")
    watched, seen = q.observed_validation(t)
    watched.write.parquet(_Stored.path(spark, "validated", ""))
    v = q.observed_result(spark, t, seen)
    return out(v.withColumn("missing_columns", F.array_join("missing_columns", ","))
               .withColumn("high_null_columns", F.array_join("high_null_columns", ",")))


@query
def check_not_empty(spark, d):
    """Every customer is expected to have transactions."""
    expected = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("account_id"))
    return q.check_not_empty(fx.txn_dirty(spark, d), K, expected)


@query
def check_null_share(spark, d):
    return q.check_null_share(fx.txn_dirty(spark, d), K)


@query
def check_amount_signs(spark, d):
    return q.check_amount_signs(fx.table(spark, d, "customer"), ("c_mktsegment",), "c_acctbal")


@query
def validation_statistics(spark, d):
    return out(q.validation_statistics(fx.txn_big(spark, d), K))


@query
def scan_sensitive(spark, d):
    return q.scan_sensitive(fx.table(spark, d, "documents"), ["text", "lang", "source"])


# --- 2.12 rules and insights --------------------------------------------------------------------------

@query
def rule_high_spending_category(spark, d):
    return r.rule_high_spending_category(clean(spark, d), K)


@query
def rule_low_savings_rate(spark, d):
    return r.rule_low_savings_rate(clean(spark, d), K)


@query
def rule_small_transactions(spark, d):
    return r.rule_small_transactions(clean(spark, d), K)


@query
def rule_subscriptions(spark, d):
    return r.rule_subscriptions(clean(spark, d), K)


@query
def recommendations(spark, d):
    return r.recommendations(clean(spark, d), K)


def clean_dirty(spark, d):
    """Cleaned dirty rows, with keywords for investments."""
    words = (*schema.CATEGORY_KEYWORDS, fx.INVESTMENT_KEYWORDS)
    return cl.clean_transactions(fx.txn_dirty(spark, d), K, vocabulary=words)


def _insight(fn_name):
    def run(spark, d):
        return getattr(r, fn_name)(clean_dirty(spark, d), K)
    run.__name__ = fn_name
    return query(run)


for _n in ("insight_overspend", "insight_top_category", "insight_transaction_size", "insight_food_share",
           "insight_entertainment_share", "insight_investing", "insight_monthly_average"):
    _insight(_n)


@query
def rule_based_insights(spark, d):
    return r.rule_based_insights(clean_dirty(spark, d), K)


@query
def build_insight_prompt(spark, d):
    return r.build_insight_prompt(clean(spark, d), K)


def answers(spark, d):
    """Conversation turns as model answers: JSON within prose, lists that are no lists, cut JSON and plain text."""
    c = fx.table(spark, d, "conversations")
    said = F.coalesce(F.trim(F.regexp_replace("text", "[^A-Za-z0-9 ]", "")), F.lit(""))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5))
    quoted = F.concat(F.lit('"'), said, F.lit('"'))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("answer_id"),
        F.when(kind == 0, F.concat(F.lit('Here: {"key_insights": ['), quoted, F.lit(', "b"], "positive_habits": ['), quoted,
                                   F.lit('], "additional_notes": '), quoted, F.lit("} bye")))
        .when(kind == 1, F.concat(F.lit('{"improvement_areas": '), quoted, F.lit(', "budget_recommendations": [{"n": 1}, '),
                                  quoted, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit('{"key_insights": ['), quoted))
        .when(kind == 3, said).otherwise(F.translate("text", "{}", "")).alias("response"))


@query
def parse_insight_response(spark, d):
    parsed = r.parse_insight_response(answers(spark, d), ("answer_id",))
    return parsed.select("answer_id", *[F.concat_ws("|", c).alias(c) for c in r.RESPONSE_LISTS],
                         "additional_notes", "llm_analysis", "insights_type")


def review(prompts: list[str]) -> list[str | Exception]:
    """A fixed model: by the number of payments it fails, answers in prose, or answers in JSON with two of the prompt's lines."""
    answers = []
    for prompt in prompts:
        lines = prompt.split("\n")
        number = int(next(x for x in lines if x.startswith("payments: ")).removeprefix("payments: "))
        answers.append(ConnectionError() if number % 3 == 0 else f"I looked at {number} payments" if number % 3 == 1 else
                       json.dumps({"key_insights": [lines[1], lines[2]], "additional_notes": f"{number} payments"}, ensure_ascii=False))
    return answers


@query
def score_prompts(spark, d):
    """Answers to every account's prompt; calls fail for some accounts."""
    return r.score_prompts(r.build_insight_prompt(clean(spark, d), K), review, K, batch=32)


@query
def model_insights(spark, d):
    """Insights of every account: parsed answers, and the rules' where the call failed."""
    parsed, rule = r.model_insights(clean(spark, d), review, K, batch=32)
    return r.insight_rows(parsed, rule, K)


@query
def format_advice(spark, d):
    return r.format_advice(r.rule_based_insights(clean_dirty(spark, d), K), K)


@query
def format_model_advice(spark, d):
    return r.format_model_advice(r.parse_insight_response(answers(spark, d), ("answer_id",)), ("answer_id",))


def registered() -> dict[str, Query]:
    return dict(QUERIES)

