"""Transaction tables derived from the given parquet tables.

``txn`` projects ``events`` onto the transactions schema, ``txn_big`` projects
``lineitem`` joined with ``part``.  ``statement_pages`` renders ``txn`` as
payment-app statement text, so the parsers run over text whose expected rows
are known.

A rendered statement holds one account's transactions within one block of
``STATEMENT_SPAN`` consecutive event ids, a page those within one block of
``PAGE_SPAN`` ids.  ``event_id`` is unique, so a statement never holds more
than ``STATEMENT_SPAN`` transactions and a page never more than ``PAGE_SPAN``,
however the rows are spread over accounts or days: a hot account yields more
statements, not a bigger one.

``txn_dirty`` is ``txn`` with what the cleaning rules are for: repeated rows, negative, zero and
null amounts, null descriptions (many in some accounts), food-heavy accounts and investments.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

# Fixed description strings of the txn fixture, indexed by event_id % 16.
TXN_DESCRIPTIONS = (
    "Paid to Zomato on UPI", "Sent to Ola Cabs via wallet", "Received from Ravi Kumar",
    "Paid to Amazon Pay for order 24", "Netflix subscription", "ATM cash withdrawal",
    "Airtel recharge #99", "Paid to 7Eleven store", "BigBasket groceries", "Transfer to self",
    "Cola service centre", "Paid to Big Onion", "Uber ride -- auto", "to Dmart", "Spotify", "UPI",
)
APPS_BY_ACCOUNT = ("paytm", "gpay", "phonepe")
STATEMENT_SPAN = 65536        # event ids per statement block (<= transactions per statement)
PAGE_SPAN = 4096              # event ids per page block (<= transactions per page)
STATEMENTS_PER_ACCOUNT = 1 << 20   # statement_id = account_id * this + statement block
STATEMENT_HEADERS = {"paytm": "Paytm statement", "gpay": "Google Pay statement", "phonepe": "Phonepe statement"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as transactions: one statement per account, line_no = event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("statement_id"),
        F.col("user_id").alias("account_id"),
        F.col("event_id").alias("line_no"),
        F.col("ts").cast("date").alias("date"),
        F.col("ts").alias("datetime"),
        _pick(F.col("event_id") % 16, TXN_DESCRIPTIONS).alias("description"),
        F.col("value").cast(schema.MONEY).alias("amount"),
        F.when(F.col("event_type").isin("purchase", "view", "click"), "debit").otherwise("credit")
        .alias("transaction_type"),
        _pick(F.col("user_id") % 3, APPS_BY_ACCOUNT).alias("app_source"),
        F.month("ts").alias("month"),
        F.year("ts").alias("year"),
    )


# Fixed rules of the dirty fixture; the oracle states the same ones in SQL.
DIRTY_FOOD, DIRTY_INVESTMENT = "Swiggy dinner order", "Monthly SIP mutual fund"
INVESTMENT_KEYWORDS = ("Investment", ("sip", "mutual fund"))


def txn_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn`` with every fifth event twice, signs, zeros and nulls mixed in, and uneven accounts."""
    t = txn(spark, sf_dir)
    event, account = F.col("line_no"), F.col("account_id")
    amount = (F.when(event % 17 == 4, F.lit(None)).when(event % 11 == 3, F.lit(0).cast(schema.MONEY))
              .when(event % 7 == 2, -F.col("amount")).otherwise(F.col("amount")))
    description = (F.when((account % 4 == 1) & (event % 3 == 0), F.lit(None))
                   .when((account % 5 == 2) & (event % 4 != 1), F.lit(DIRTY_FOOD))
                   .when((account % 6 == 3) & (event % 8 == 5), F.lit(DIRTY_INVESTMENT)).otherwise(F.col("description")))
    copies = F.when(event % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dirty = t.withColumns({"amount": amount, "description": description})
    return (dirty.select("*", F.explode(copies).alias("copy"))
            .withColumn("line_no", F.col("line_no") * 2 + F.col("copy")).drop("copy"))


def txn_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` joined with ``part``: multi-year, amounts above the cap,
    non-unique line numbers.  Join strategy is left to AQE (part is not
    assumed small)."""
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(pa, li.l_partkey == pa.p_partkey, "inner")
    return j.select(
        F.col("l_suppkey").alias("statement_id"),
        F.col("l_suppkey").alias("account_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_shipdate").alias("datetime"),
        F.col("p_name").alias("description"),
        F.col("l_extendedprice").cast(schema.MONEY).alias("amount"),
        F.when(F.col("l_returnflag").isin("A", "N"), "debit").otherwise("credit").alias("transaction_type"),
        F.lit("paytm").alias("app_source"),
        F.month("l_shipdate").alias("month"),
        F.year("l_shipdate").alias("year"),
    )


def render_line(app: str = "app_source") -> F.Column:
    """One transaction as statement text in its app's layout."""
    amt = F.concat(F.lit("₹"), F.col("amount").cast("string"))
    paytm = F.concat_ws(" ", F.date_format("datetime", "dd/MM/yyyy HH:mm:ss"), "description", amt)
    gpay = F.concat_ws(
        "\n",
        F.concat(F.when(F.col("transaction_type") == "debit", "Paid to ").otherwise("Received from "),
                 F.col("description")),
        F.date_format("datetime", "d MMM yyyy, h:mm a"),
        amt,
    )
    phonepe = F.concat_ws(" ", F.date_format("datetime", "dd-MM-yyyy HH:mm"), "description", amt)
    return (F.when(F.col(app) == "paytm", paytm).when(F.col(app) == "gpay", gpay).otherwise(phonepe))


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(statement_id, page_no, text)``: page 0 is the header, page b+1 holds
    the statement's transactions of page block b, in time order.

    Pages are gathered per (statement, page block): at most ``PAGE_SPAN`` lines.
    """
    t = txn(spark, sf_dir).select(
        F.expr(f"account_id * {STATEMENTS_PER_ACCOUNT} + line_no div {STATEMENT_SPAN}").alias("statement_id"),
        F.expr(f"CAST((line_no % {STATEMENT_SPAN}) div {PAGE_SPAN} + 1 AS INT)").alias("page_no"),
        "account_id", "app_source", "line_no", "datetime", render_line().alias("line"),
    )
    body = (
        t.groupBy("statement_id", "page_no")
        .agg(F.array_sort(F.collect_list(F.struct("datetime", "line_no", "line"))).alias("ls"))
        .select("statement_id", "page_no", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))
    )
    header = (
        t.select("statement_id", "app_source").distinct()
        .select("statement_id", F.lit(0).alias("page_no"),
                F.element_at(F.create_map(*[F.lit(x) for kv in STATEMENT_HEADERS.items() for x in kv]),
                             F.col("app_source")).alias("text"))
    )
    return header.unionByName(body)


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered statements as binary file rows ``(path, modificationTime, length, content)``.

    Pages are separated by form feeds.  Every seventh statement is not UTF-8 (a byte 0xFF in front),
    every eleventh is blank, every thirteenth holds no transaction.
    """
    from ..operators.parse import assemble_statement_text

    st = assemble_statement_text(statement_pages(spark, sf_dir), separator="\f")
    number = F.col("statement_id") % 1001
    text = (F.when(number % 11 == 3, F.lit(" \n")).when(number % 13 == 5, F.lit("Paytm statement\nnothing here"))
            .otherwise(F.col("text")))
    content = F.when(number % 7 == 1, F.concat(F.unhex(F.lit("FF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    return st.select(
        F.concat(F.lit("statements/"), F.col("statement_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.octet_length(content).cast("long").alias("length"),
        content.alias("content"),
    )
