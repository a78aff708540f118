"""Exact order statistics without bringing a group together: the wanted rank's range of values is narrowed round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Into how many ranges a round cuts each wanted rank's range; four rounds find a rank among 2^40 whole numbers.
RANGES = 1024
#: Wanted ranks up to so many go to every task; more are joined by a shuffle.
BROADCAST_RANKS = 100_000


def at_ranks(values: DataFrame, ranks: DataFrame, *keys: str) -> DataFrame:
    """``ranks`` (keys, name, rank: from 1) with ``value``: the rank-th smallest of the longs ``value`` of their group.

    A round counts the values of each range of a rank's interval, with partial sums before the shuffle, and keeps the
    one range that the rank falls in. So a group's values never meet, and a round shuffles at most ``RANGES`` rows a task
    and rank. Rounds end when all ranges are one value wide; their number depends on how far apart values are, not on how
    many there are. Ranks beyond a group's size have no value; null values don't count.
    """
    values = kept(values.select(*keys, "value").where("value is not null"))
    ends = values.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("__n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]

    def joined(left: DataFrame, right: DataFrame, *columns) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        both = a.join(b, same) if same else a.crossJoin(b)
        return both.select(*(F.col(f"a.{k}").alias(k) for k in keys), *columns)

    todo = joined(ranks, F.broadcast(ends) if not keys else ends, "name", "rank", "low", (F.col("high") - F.col("low") + 1).alias("span"), "__n")
    todo = kept(todo.where((F.col("rank") >= 1) & (F.col("rank") <= F.col("__n"))).drop("__n"))
    few = todo.count() <= BROADCAST_RANKS
    while todo.where("span > 1").head(1):
        asked = todo.withColumn("width", F.ceil(F.col("span") / RANGES))
        at = F.expr("(value - low) div width")
        near = joined(values, F.broadcast(asked) if few else asked, "name", "rank", "low", "width", at.alias("part"), (F.col("value") >= F.col("low")) & (F.col("value") < F.col("low") + F.col("span")).alias("inside"))
        near = near.toDF(*keys, "name", "rank", "low", "width", "part", "inside").where("inside")
        counts = near.groupBy(*keys, "name", "rank", "low", "width", "part").agg(F.count("*").alias("n"))
        own = Window.partitionBy(*keys, "name", "rank").orderBy("part")
        counts = counts.withColumn("upto", F.sum("n").over(own)).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        todo = kept(counts.select(*keys, "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), (F.col("low") + F.col("part") * F.col("width")).alias("low"), F.col("width").alias("span")))
    return todo.select(*keys, "name", F.col("low").alias("value"))


def nearest_rank(p: float, n):
    """The rank of percentile ``p`` (0 to 1) among ``n`` values; exact for percentages, where floating point may be just above."""
    return F.greatest(F.lit(1), F.expr(f"cast(ceil(cast('{p}' as decimal(9,6)) * {n}) as bigint)"))


def medians(values: DataFrame, *keys: str) -> DataFrame:
    """keys, median (double): the middle value, or the mean of the middle two."""
    n = values.where("value is not null").groupBy(*keys).agg(F.count("*").alias("n"))
    ranks = n.select(*keys, F.explode(F.array(F.struct(F.lit("a").alias("name"), F.expr("(n + 1) div 2").alias("rank")), F.struct(F.lit("b").alias("name"), F.expr("n div 2 + 1").alias("rank")))).alias("r")).select(*keys, "r.name", "r.rank")
    return at_ranks(values, kept(ranks), *keys).groupBy(*keys).agg((F.sum("value") / 2).alias("median"))
