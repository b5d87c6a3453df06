"""Data-quality and privacy checks, each one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import S_CHARS

# Fixed patterns of the privacy scan (applied to lower-cased text).
# A run of ten is enough to tell that a longer one, or one after a plus sign, is there.
ACCOUNT_PATTERN = r"[0-9]{10}"
PHONE_PATTERN = rf"[0-9{S_CHARS}\-$]{{10}}"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"


def check_required_columns(spark: SparkSession, df: DataFrame,
                           required: Sequence[str] = schema.REQUIRED_COLUMNS) -> DataFrame:
    """Schema check (driver-side metadata only): ``(column, present)``."""
    cols = set(df.columns)
    return spark.createDataFrame([(c, c in cols) for c in required], "column string, present boolean")


def check_not_empty(df: DataFrame, keys: Sequence[str] = (), expected: DataFrame | None = None) -> DataFrame:
    """Rows per key; with ``expected`` (the keys that should be there), keys without rows are reported too."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    if expected is not None:
        counts = (expected.select(*keys).distinct().join(counts, list(keys), "left")
                  .withColumn("n_rows", F.coalesce("n_rows", F.lit(0))))
    return counts.withColumn("not_empty", F.col("n_rows") > 0)


def check_null_share(df: DataFrame, keys: Sequence[str] = (), required: Sequence[str] = schema.REQUIRED_COLUMNS,
                     warn_share: float = schema.NULL_SHARE_WARN) -> DataFrame:
    """Per required column present: null count and whether it exceeds the share."""
    present = [c for c in required if c in df.columns]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                 *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in present])
    pairs = ", ".join(f"'{c}', _null_{c}" for c in present)
    long = wide.select(*keys, "_n", F.expr(f"stack({len(present)}, {pairs}) as (column, n_null)"))
    return long.select(*keys, "column", "n_null",
                       (F.col("n_null") > F.col("_n") * F.lit(warn_share)).alias("warn"))


def check_amount_signs(df: DataFrame, keys: Sequence[str] = (), col: str = "amount") -> DataFrame:
    a = F.col(col)
    return df.groupBy(*keys).agg(F.count_if(a < 0).alias("n_negative"), F.count_if(a == 0).alias("n_zero"))


def validation_statistics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    if "date" in df.columns:
        aggs += [F.min("date").alias("start_date"), F.max("date").alias("end_date")]
    if "amount" in df.columns:
        aggs += [F.coalesce(F.sum("amount"), F.lit(0)).alias("total_amount")]
    return df.groupBy(*keys).agg(*aggs)


def validate_transactions(df: DataFrame, keys: Sequence[str] = (),
                          required: Sequence[str] = schema.REQUIRED_COLUMNS,
                          warn_share: float = schema.NULL_SHARE_WARN) -> DataFrame:
    """All checks in one aggregate per key.

    ``is_valid`` is false when a required column is missing or the key has no
    rows; missing columns are reported, the others are still checked.
    """
    return _validation_verdict(df.groupBy(*keys).agg(*_validation_sums(df, required)), df, required, warn_share)


def _validation_sums(df: DataFrame, required: Sequence[str]) -> list[F.Column]:
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required if c in df.columns]
    if "amount" in df.columns:
        aggs += [F.count_if(F.col("amount") < 0).alias("n_negative"), F.count_if(F.col("amount") == 0).alias("n_zero"),
                 F.coalesce(F.sum("amount"), F.lit(0)).alias("total_amount")]
    if "date" in df.columns:
        aggs += [F.min("date").alias("start_date"), F.max("date").alias("end_date")]
    return aggs


def _validation_verdict(out: DataFrame, df: DataFrame, required: Sequence[str], warn_share: float) -> DataFrame:
    present = [c for c in required if c in df.columns]
    missing = [c for c in required if c not in df.columns]
    high_null = F.filter(F.array(*[F.when(F.col(f"null_{c}") > F.col("n_rows") * F.lit(warn_share), F.lit(c))
                                   for c in present]), lambda x: x.isNotNull()) if present else F.array()
    return out.select(
        "*",
        ((F.col("n_rows") > 0) & F.lit(not missing)).alias("is_valid"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
        high_null.cast("array<string>").alias("high_null_columns"),
    )


def observed_validation(df: DataFrame, required: Sequence[str] = schema.REQUIRED_COLUMNS) -> tuple[DataFrame, "Observation"]:
    """``df`` with the sums of ``validate_transactions`` over the whole table gathered while an action runs on it.

    Whatever writes the returned table fills the observation, so the check needs no scan of its own;
    ``observed_result`` makes the check's row of it.
    """
    observation = Observation()
    return df.observe(observation, *_validation_sums(df, required)), observation


def observed_result(spark: SparkSession, df: DataFrame, observation: "Observation",
                    required: Sequence[str] = schema.REQUIRED_COLUMNS, warn_share: float = schema.NULL_SHARE_WARN) -> DataFrame:
    """The row of ``validate_transactions`` from the sums that a finished action has gathered (one row, from the driver)."""
    sums = df.limit(0).agg(*_validation_sums(df, required)).schema
    found = spark.createDataFrame([tuple(observation.get[f.name] for f in sums.fields)], sums)
    return _validation_verdict(found, df, required, warn_share)


def scan_sensitive(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per string column: rows holding an account-like number, a phone-like run
    or an e-mail address (lower-cased text), one aggregate pass over all columns."""
    cols = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    aggs = []
    for c in cols:
        # digits and blanks have no case; only texts with an @ can hold an address
        aggs += [F.count_if(F.col(c).rlike(ACCOUNT_PATTERN)).alias(f"{c}__acct"),
                 F.count_if(F.col(c).rlike(PHONE_PATTERN)).alias(f"{c}__phone"),
                 F.count_if(F.contains(c, F.lit("@")) & F.lower(F.col(c)).rlike(EMAIL_PATTERN)).alias(f"{c}__email")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', `{c}__acct`, `{c}__phone`, `{c}__email`" for c in cols)
    long = wide.select(F.expr(f"stack({len(cols)}, {parts}) as (column, n_account_numbers, n_phone_numbers, "
                              f"n_email_addresses)"))
    return long.select("*",
                       (F.col("n_account_numbers") > 0).alias("has_account_numbers"),
                       (F.col("n_phone_numbers") > 0).alias("has_phone_numbers"),
                       (F.col("n_email_addresses") > 0).alias("has_email_addresses"))
