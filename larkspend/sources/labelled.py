"""Labelled payment files: CSV with a header, one file (or folder of parts named like one) a period, training first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import minor_units
from ..schemas import TIERS

#: The columns that are read; files hold others, which are never parsed into rows.
COLUMNS = ("cc_num", "merchant", "category", "amt", "lat", "long", "trans_num", "unix_time", "merch_lat", "merch_long", "is_fraud")
LIMIT_STEPS = 26
#: Feed order. Without an index column lines count up inside a block of a file, which a reader may split.
ORDER = ("file_rank", "name", "part", "block", "line")


def read(spark: SparkSession, paths, limit: int | None = None, period: str | None = None) -> DataFrame:
    """Rows with period, file_rank, name and seq. ``limit`` counts in feed order; ``period`` keeps one file's rows."""
    raw = spark.read.options(header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(paths)
    # ``x.csv`` as a file, or as a folder that Spark wrote
    path = F.col("_metadata.file_path")
    name = F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]+\.csv)/[^/]*$", 1), F.lit("")), F.col("_metadata.file_name"))
    index = next((F.col(f"`{c}`") for c in raw.columns if c in ("_c0", "")), F.monotonically_increasing_id()).cast("long")
    rows = raw.select(*COLUMNS, name.alias("name"), F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("block"), index.alias("line"))
    rows = rows.where(F.lower("name").endswith(".csv"))
    if not rows.head(1):
        raise ValueError(f"no rows in .csv files under {paths}")
    rows = rows.withColumn("period", F.regexp_replace("name", r"\.csv$", "")).withColumn("file_rank", F.when(F.lower("name").contains("train"), 0).otherwise(1))
    if period is not None:
        rows = rows.where(F.lower("period") == period.lower())
        if not rows.head(1):
            raise ValueError(f"no file named {period}")
    if limit is not None:
        rows = rows.orderBy(*ORDER).limit(limit)
    return rows.withColumn("seq", F.struct(*ORDER))


def merchant_name(column) -> Column:
    return F.regexp_replace(column, "^fraud_", "")


def transactions(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("trans_num").alias("transaction_id"), F.col("cc_num").alias("card_id"), merchant_name(F.col("merchant")).alias("merchant_id"), minor_units(F.col("amt")).alias("amount_minor"), F.lit("EUR").alias("currency"),
        (F.col("unix_time").cast("long") * 1000).alias("t"), F.col("merch_lat").cast("double").alias("lat"), F.col("merch_long").cast("double").alias("lon"), "category", (F.col("is_fraud") == "1").alias("labelled_fraud"), "period", "seq",
    )


def _digits(seed: int, at: int) -> Column:
    """A number from the digest of seed and card: the same on every run and cluster."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("card_id"))), at, 8), 16, 10).cast("long")


def profiles(rows: DataFrame, seed: int = 42) -> DataFrame:
    """A card and its customer for each card number, from its first row."""
    first = rows.groupBy(F.col("cc_num").alias("card_id")).agg(F.min_by(F.struct("lat", "long"), "seq").alias("v"))
    tier = F.array(*map(F.lit, TIERS))
    return first.select(
        "card_id", F.concat(F.lit("SPARKOV-"), "card_id").alias("customer_id"), F.lit("ACTIVE").alias("status"), (50_000 + _digits(seed, 1) % LIMIT_STEPS * 10_000).alias("daily_limit_minor"), F.lit("EUR").alias("currency"),
        F.get(tier, (_digits(seed, 9) % 3).cast("int")).alias("risk_tier"), F.lit("US").alias("home_country"), F.col("v.lat").cast("double").alias("home_lat"), F.col("v.long").cast("double").alias("home_lon"),
    )


def merchants(rows: DataFrame) -> DataFrame:
    first = rows.groupBy(merchant_name(F.col("merchant")).alias("merchant_id")).agg(F.min_by(F.struct("category", "merch_lat", "merch_long"), "seq").alias("v"))
    return first.select("merchant_id", F.col("merchant_id").alias("name"), F.col("v.category").alias("mcc"), F.lit("US").alias("country"), F.col("v.merch_lat").cast("double").alias("lat"), F.col("v.merch_long").cast("double").alias("lon"))
