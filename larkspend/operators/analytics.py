"""Merchant windows: counts and decline rate per five minutes, final once closed, with grace for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

WINDOW_MS = 300_000
GRACE_MS = 30_000
HELD = 12


def _counts(rows: DataFrame) -> DataFrame:
    start = (F.floor(F.col("t") / WINDOW_MS) * WINDOW_MS).alias("window_start")
    per = rows.groupBy("merchant_id", start).agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "DECLINE").alias("declined"))
    return per.withColumn("window_end", F.col("window_start") + WINDOW_MS).withColumn("decline_rate", ratio(F.col("declined"), F.col("total")))


def arrival_clock(decisions: DataFrame, order: str = "seq", bucket_rows: int = 100_000, feed: DataFrame | None = None) -> DataFrame:
    """Adds ``now``, the stream's time at each row's arrival: the running maximum of event time in arrival order.

    ``order`` is a long. ``feed`` (order, t of the same rows) gives the clock where decisions are dear to make twice. The
    maximum runs inside ranges of it and, over one row a range, before them, so no task sees
    the whole feed.
    """
    rows = decisions.withColumn("__bucket", F.floor(F.col(order) / bucket_rows))
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    clock = rows if feed is None else feed.withColumn("__bucket", F.floor(F.col(order) / bucket_rows))
    earlier = clock.groupBy("__bucket").agg(F.max("t").alias("__top")).withColumn("__before", F.max("__top").over(before)).drop("__top")
    inside = Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    now = F.greatest(F.max("t").over(inside), F.col("__before"))
    return rows.join(earlier, "__bucket").withColumn("now", now).drop("__before", "__bucket")


def in_grace(decisions: DataFrame, order: str = "seq", bucket_rows: int = 100_000, feed: DataFrame | None = None) -> DataFrame:
    """Rows that arrive before their window closes (``arrival_clock``)."""
    end = (F.floor(F.col("t") / WINDOW_MS) + 1) * WINDOW_MS
    return arrival_clock(decisions, order, bucket_rows, feed).where(end + GRACE_MS > F.col("now")).drop("now")


def final_windows(decisions: DataFrame, ordered: bool = True, order: str = "seq", feed: DataFrame | None = None) -> DataFrame:
    """One row a merchant and closed window. A feed in event-time order has no late rows, so it needs no running
    maximum and the count is a single shuffle of pre-aggregated rows. ``feed`` gives the clock, as in ``in_grace``."""
    kept = decisions if ordered else in_grace(decisions, order, feed=feed)
    now = (decisions if feed is None else feed).agg(F.max("t").alias("__now"))
    return _counts(kept).crossJoin(F.broadcast(now)).where(F.col("window_end") + GRACE_MS <= F.col("__now")).drop("__now")


def latest_windows(decisions: DataFrame, now_ms: int, held: int = HELD, merchant_id=None) -> DataFrame:
    """Per merchant the ``held`` latest windows, open ones too, newest first, and whether each is closed at ``now_ms``.
    A ``merchant_id`` looks that merchant up."""
    if merchant_id is not None:
        decisions = decisions.where(F.col("merchant_id") == merchant_id)
    rank = F.row_number().over(Window.partitionBy("merchant_id").orderBy(F.desc("window_start")))
    return _counts(decisions).withColumn("position", rank).where(F.col("position") <= held).withColumn("closed", F.col("window_end") + GRACE_MS <= now_ms)
