"""Query views: a card's risk, the decision feed, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..policy import DAY_MS, TESTING_MS, VELOCITY_MS
from ..schemas import VERDICTS

RECENT = 200
TAIL = 40


def card_risk(profiles: DataFrame, state: DataFrame, attempts: DataFrame, now_ms: int, card_id=None) -> DataFrame:
    """Profile, today's spend, last location, recent activity and latest decision with its rules; a card of which none is known has
    no row. ``attempts``: card_id, t of every transaction; a ``card_id`` is pushed into every side."""
    if card_id is not None:
        profiles, state, attempts = (x.where(F.col("card_id") == card_id) for x in (profiles, state, attempts))
    recent = attempts.where(F.col("t").between(now_ms - TESTING_MS, now_ms)).groupBy("card_id").agg(
        F.count("*").alias("attempts_10m"), F.count_if(F.col("t") >= now_ms - VELOCITY_MS).alias("attempts_60s"), F.max("t").alias("last_attempt")
    )
    joined = profiles.join(state, "card_id", "full").join(recent, "card_id", "full")
    spent = F.when(F.col("spend_day") == now_ms // DAY_MS, F.col("spent_minor")).otherwise(0)
    return joined.select(
        "card_id", "status", "risk_tier", "daily_limit_minor", spent.alias("spent_today"), F.when(F.col("daily_limit_minor").isNotNull(), F.greatest(F.lit(0), F.col("daily_limit_minor") - spent)).alias("remaining"),
        "last_lat", "last_lon", "last_seen", "last_place", F.coalesce("attempts_10m", F.lit(0)).alias("attempts_10m"), F.coalesce("attempts_60s", F.lit(0)).alias("attempts_60s"), "last_attempt", F.col("txn_id").alias("last_txn"), F.col("decision").alias("last_decision"), F.col("score").alias("last_score"), F.col("reasons.rule").alias("last_rules"),
    )


def feed(decisions: DataFrame, most: int = RECENT) -> DataFrame:
    """The latest decisions, newest first."""
    return decisions.orderBy(F.desc("evaluated_at_ms"), F.desc("txn_id")).limit(most)


def feed_tail(decisions: DataFrame, partition: str = "src_partition", offset: str = "src_offset", most: int = TAIL) -> DataFrame:
    """The last decisions of each source partition."""
    rank = F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(offset)))
    return decisions.withColumn("position", rank).where(F.col("position") <= most)


def verdict_totals(decisions: DataFrame) -> DataFrame:
    """Count and share of each verdict, absent ones with 0."""
    every = decisions.sparkSession.createDataFrame([(v,) for v in VERDICTS], "decision string")
    n = every.join(decisions.groupBy("decision").agg(F.count("*").alias("n")), "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))
    return n.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def rule_totals(reasons: DataFrame) -> DataFrame:
    """Hits of each rule and their share of the largest."""
    n = reasons.groupBy("rule").agg(F.count("*").alias("n"))
    return n.withColumn("bar", F.col("n") / F.max("n").over(Window.partitionBy()))


def dead_letter_totals(bad: DataFrame) -> DataFrame:
    return bad.groupBy("src_topic").agg(F.count("*").alias("n"))
