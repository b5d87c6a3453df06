"""Rows-only operators: files, decoding, load/save (scratch folders from mkdtemp)."""

import os
import tempfile

from pyspark.sql import functions as F

from txnlens.sources import files as fl


def test_scan_and_read_pages(spark):
    d = tempfile.mkdtemp(prefix="txnlens-io-")
    with open(os.path.join(d, "a.pdf"), "wb") as f:
        f.write("Paytm statement\n05/01/2024 10:15:00 Paid to X ₹10\fpage two".encode())
    with open(os.path.join(d, "b.pdf"), "wb") as f:
        f.write(b"\xff\xfe\xfa")
    with open(os.path.join(d, "c.txt"), "wb") as f:
        f.write(b"x")
    st = {os.path.basename(x["path"]): x["status"] for x in fl.scan_statement_files(spark, d).collect()}
    assert st == {"a.pdf": "valid", "b.pdf": "valid", "c.txt": "File is not a PDF"}
    limited = {os.path.basename(x["path"]): x["status"] for x in fl.scan_statement_files(spark, d, max_mb=1e-5).collect()}
    assert limited == {"a.pdf": "too big", "b.pdf": "valid", "c.txt": "File is not a PDF"}
    expected = spark.createDataFrame([(f"file:{d}/a.pdf",), (f"file:{d}/gone.pdf",)], "path string")
    absent = {os.path.basename(x["path"]): x["status"] for x in fl.scan_statement_files(spark, d, expected=expected).collect()}
    assert absent["gone.pdf"] == "missing" and absent["a.pdf"] == "valid" and len(absent) == 4
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(d)
    pages = fl.read_statement_pages(files).orderBy("path", "page_no").collect()
    assert [(os.path.basename(p["path"]), p["page_no"], p["status"]) for p in pages] == [
        ("a.pdf", 0, "ok"), ("a.pdf", 1, "ok"), ("b.pdf", 0, "failed: UnicodeDecodeError")]


def test_save_load_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="txnlens-io-")
    df = spark.range(5).select(F.col("id").alias("k"), F.current_date().alias("date"))
    for fmt in ("csv", "json"):
        p = os.path.join(d, f"t.{fmt}")
        assert fl.save_table(df, p, fmt)
        back = fl.load_table(spark, p, "k long, date date")
        assert sorted(back.collect()) == sorted(df.collect())
    arr = os.path.join(d, "arr.json")
    with open(arr, "w") as f:
        f.write('[{"k": 1}, {"k": 2}]')
    assert fl.load_table(spark, arr, json_array=True).count() == 2
    try:
        fl.load_table(spark, os.path.join(d, "x.xlsx"))
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_sample_transactions(spark):
    s = fl.sample_transactions(spark)
    assert s.count() == 91
    b = s.agg(F.min("amount"), F.max("amount")).first()
    assert b[0] >= 100 and b[1] < 10000
