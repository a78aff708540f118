"""What was sent against what was decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .quantiles import at_ranks, nearest_rank


def match(sent: DataFrame, decided: DataFrame) -> DataFrame:
    """txn_id, latency_ms of the first decision; null where none came. ``sent``: txn_id, sent_ms; ``decided``: txn_id,
    decided_ms."""
    first = decided.groupBy("txn_id").agg(F.min("decided_ms").alias("decided_ms"))
    return sent.join(first, "txn_id", "left").select("txn_id", (F.col("decided_ms") - F.col("sent_ms")).alias("latency_ms"))


def summary(latencies: DataFrame) -> DataFrame:
    """Counts, exact nearest-rank percentiles and the maximum; latencies never meet in one task."""
    latencies = kept(latencies.select(F.col("latency_ms").cast("long").alias("value")))
    counts = kept(latencies.agg(F.count("*").alias("sent"), F.count("value").alias("received"), (F.count("*") - F.count("value")).alias("missing"), F.max("value").alias("max")))
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ranks = counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), nearest_rank(p, "received").alias("rank")) for name, p in wanted.items()))).alias("r")).select("r.*")
    found = at_ranks(latencies, ranks).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted))
    return counts.crossJoin(F.broadcast(found)).select("sent", "received", "missing", *wanted, "max")
