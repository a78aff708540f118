"""The driver's tables as a card feed: times squeezed into bursts, ten users a card, reference data by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MCCS = (5411, 5812, 5541, 7995, 6051, 5732, 4121, 5999)
TRAIN_DAYS = 20


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def transactions(raw: DataFrame) -> DataFrame:
    """The feed, in order of (t, transaction_id); ``seq`` is that order, as a pair."""
    raw = raw.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("day", F.expr("ms - ms % 86400000"))
    cents = F.round(F.col("value") * 100).cast("long")
    rows = raw.select(
        F.col("event_id").alias("transaction_id"), F.expr("user_id div 10").alias("card_id"), F.when(F.col("event_id") % 13 == 12, -1).otherwise(F.col("event_id") % 13).cast("long").alias("merchant_id"),
        F.when(F.col("event_type") == "click", cents % 200).otherwise(cents).alias("amount_minor"), F.lit("EUR").alias("currency"), F.expr("day + (ms - day) div 240").alias("t"),
        F.expr("cast((user_id div 10) % 40 + 10 + ((event_id % 21) - 10) * 0.01 + case when event_id % 17 = 0 then 30 when event_id % 19 = 0 then 2 else 0 end as double)").alias("lat"),
        F.expr("cast((user_id div 10) % 90 * 1.0 + ((event_id % 9) - 4) * 0.01 as double)").alias("lon"), F.lit(None).cast("string").alias("category"),
        F.when(F.col("event_type") != "view", F.col("event_type") == "error").alias("labelled_fraud"), F.expr("ms div 86400000").alias("source_day"),
    )
    return rows.withColumn("seq", F.struct("t", "transaction_id"))


def with_period(rows: DataFrame) -> DataFrame:
    first = rows.agg(F.min("source_day").alias("__d"))
    return rows.crossJoin(F.broadcast(first)).withColumn("period", F.when(F.col("source_day") < F.col("__d") + TRAIN_DAYS, "train").otherwise("test")).drop("__d")


def cards(txns: DataFrame) -> DataFrame:
    c = F.col("card_id")
    rows = txns.select("card_id").distinct().where(c % 15 != 14)
    status = F.when(c % 15 == 13, "BLOCKED").when(c % 15 == 12, "EXPIRED").otherwise("ACTIVE")
    return rows.select("card_id", F.when(c % 15 == 11, -1).otherwise(c).cast("long").alias("customer_id"), status.alias("status"), (50_000 + c * 7 % 26 * 10_000).alias("daily_limit_minor"), F.lit("EUR").alias("currency"))


def customers(txns: DataFrame) -> DataFrame:
    c = F.col("card_id")
    tier = F.when(c % 3 == 0, "LOW").when(c % 3 == 1, "MEDIUM").otherwise("HIGH")
    return txns.select("card_id").distinct().select(c.alias("customer_id"), tier.alias("risk_tier"), F.lit("DE").alias("home_country"), (c % 40 + 10).cast("double").alias("home_lat"), (c % 90).cast("double").alias("home_lon"))


def merchants(txns: DataFrame) -> DataFrame:
    """Merchants 0 to 11, where the feed has them."""
    m = F.col("merchant_id")
    mcc = F.get(F.array(*map(F.lit, map(str, MCCS))), (m % len(MCCS)).cast("int"))
    return txns.select("merchant_id").distinct().where(m >= 0).select("merchant_id", F.concat(F.lit("M"), m).alias("name"), mcc.alias("mcc"), F.concat(F.lit("C"), m % 5).alias("country"), (m * 3.0 + 10).alias("lat"), (m * 7.0).alias("lon"))


def with_gaps(txns: DataFrame) -> DataFrame:
    """Some transactions without a place, others without an amount."""
    i = F.col("transaction_id")
    gap = lambda c, n: F.when(i % n != 0, F.col(c)).alias(c)
    gaps = {"lat": gap("lat", 23), "lon": gap("lon", 31), "amount_minor": gap("amount_minor", 29)}
    return txns.select(*(gaps.get(c, F.col(c)) for c in txns.columns))


def cards_with_gaps(rows: DataFrame) -> DataFrame:
    c = F.col("card_id")
    return rows.withColumns({"status": F.when(c % 4 != 1, F.col("status")), "daily_limit_minor": F.when(c % 5 != 2, F.col("daily_limit_minor"))})
