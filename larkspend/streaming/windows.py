"""Merchant windows over a decision stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.scalars import ratio
from ..operators.analytics import GRACE_MS, WINDOW_MS, arrival_clock
from ..sources.committed import CommittedFolder


def _per_window(decisions: DataFrame) -> DataFrame:
    """Counts by Spark's watermark. Decisions that have a watermarked ``event_time`` already keep it."""
    if "event_time" not in decisions.columns:
        decisions = decisions.withColumn("event_time", F.timestamp_millis("t")).withWatermark("event_time", "30 seconds")
    per = decisions.groupBy(F.window("event_time", "5 minutes"), "merchant_id")
    per = per.agg(F.count("*").alias("total"), F.count_if(F.col("decision") == "DECLINE").alias("declined"))
    return per.select("merchant_id", F.unix_millis("window.start").alias("window_start"), F.unix_millis("window.end").alias("window_end"), "total", "declined", ratio(F.col("declined"), F.col("total")).alias("decline_rate"))


def final_windows(decisions: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each window once, when the watermark has passed its end. Spark advances the watermark
    per micro-batch, so rows may count that the exact form (``exact_windows``) drops. Decisions may come from
    ``decide_stream(event_time=True)`` in the same query."""
    return _per_window(decisions).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def live_windows(decisions: DataFrame, path: str, checkpoint: str, compact_every: int = 20):
    """Starts a query that keeps the counts of open windows: each micro-batch writes those it changed as one committed
    batch, once. Every ``compact_every`` batches the last counts of all are written as one, which readers take in place of
    the batches before it. Nothing is held in the driver."""
    spark = decisions.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        _changes(spark, path).write(batch.withColumn("batch", F.lit(number).cast("long")), number)
        if number % compact_every == compact_every - 1:
            # it holds the batches up to this one
            _compacted(spark, path).write(_latest(_all_counts(spark, path)), number)

    return _per_window(decisions).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def _changes(spark: SparkSession, path: str) -> CommittedFolder:
    return CommittedFolder(spark, f"{path}/changes")


def _compacted(spark: SparkSession, path: str) -> CommittedFolder:
    return CommittedFolder(spark, f"{path}/compacted")


def _all_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last compaction and the files of the batches after it; files of earlier batches aren't opened."""
    changes, base = _changes(spark, path), _compacted(spark, path)
    last = max(base.numbers(), default=-1)
    files = [f for n in changes.numbers() if n > last for f in changes.files(n)] + (base.files(last) if last >= 0 else [])
    return spark.read.parquet(*files)


def _latest(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("merchant_id", "window_start")]
    return rows.groupBy("merchant_id", "window_start").agg(F.max_by(F.struct(*rest), "batch").alias("v")).select("merchant_id", "window_start", "v.*")


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last count of each window, open or closed, that ``live_windows`` wrote."""
    return _latest(_all_counts(spark, path)).drop("batch")


def clocked(decisions: DataFrame, path: str, checkpoint: str, order: str = "seq"):
    """Starts a query that adds ``now``, the stream's time when a row arrived: the latest event time up to it, in the order
    of ``order`` inside a micro-batch and over all batches before it. Each batch's own latest time is in its manifest, so
    a batch looks at itself and at one number."""
    folder = CommittedFolder(decisions.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        earlier = folder.manifest(number - 1)
        before = None if earlier is None else earlier["info"]["top"]
        top = batch.agg(F.max("t")).first()[0]
        tops = [x for x in (before, top) if x is not None]
        made = arrival_clock(batch, order)
        folder.write(made if before is None else made.withColumn("now", F.greatest("now", F.lit(before))), number, {"top": max(tops, default=None)})

    return decisions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


class ExactWindows(StatefulProcessor):
    """A merchant's open windows in a map: a row counts if its window is open at the row's own arrival, and a window is
    returned once, when the stream's time has passed its end and grace."""

    names = ("merchant_id", "window_start", "window_end", "total", "declined")

    def init(self, handle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start long", "total long, declined long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: dict[int, list[int]] = {}
        for frame in rows:
            # whether a row counts depends on its own arrival alone, so rows need no order here
            frame = frame.assign(start=frame["t"] // WINDOW_MS * WINDOW_MS)
            frame = frame[frame["start"] + WINDOW_MS + GRACE_MS > frame["now"]]
            declined = (frame["decision"] == "DECLINE").groupby(frame["start"])
            for start, n, d in zip(declined.size().index.tolist(), declined.size().tolist(), declined.sum().tolist(), strict=True):
                own = added.setdefault(start, [0, 0])
                own[0] += n
                own[1] += d
        for start, (n, d) in added.items():
            old = self.windows.getValue((start,)) if self.windows.containsKey((start,)) else (0, 0)
            self.windows.updateValue((start,), (old[0] + n, old[1] + int(d)))
            self.handle.registerTimer(start + WINDOW_MS + GRACE_MS - 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() + 1 - GRACE_MS - WINDOW_MS
        if self.windows.containsKey((start,)):
            total, declined = self.windows.getValue((start,))
            self.windows.removeKey((start,))
            yield pd.DataFrame([(key[0], start, start + WINDOW_MS, total, declined)], columns=list(self.names))

    def close(self) -> None:
        pass


def exact_windows(rows: DataFrame) -> DataFrame:
    """merchant_id, window_start, window_end, total, declined, decline_rate: each window once it is closed, from a stream
    with ``now`` (``clocked``): the rows of ``analytics.final_windows(ordered=False)``.

    The watermark runs over ``now``, which never goes back in the order of arrival, a millisecond behind it; a timer stands
    where it reaches a window's end and grace.
    """
    merchant = rows.schema["merchant_id"].dataType.simpleString()
    timed = rows.where("t is not null").withColumn("clock", F.timestamp_millis("now")).withWatermark("clock", "1 millisecond")
    made = timed.select("merchant_id", "t", "decision", "now", "clock").groupBy("merchant_id").transformWithStateInPandas(ExactWindows(), f"merchant_id {merchant}, window_start long, window_end long, total long, declined long", "append", "eventTime")
    return made.withColumn("decline_rate", ratio(F.col("declined"), F.col("total")))


def totals(decisions: DataFrame, path: str, checkpoint: str):
    """Starts a query that keeps three kinds of live totals: decisions by verdict, hits by rule, and (for a stream that has
    ``exception_class``) dead letters by source. Each micro-batch writes the totals that it changed; ``latest_totals``
    reads them."""
    if "exception_class" in decisions.columns:
        kinds = decisions.select(F.lit("dead letters").alias("kind"), F.col("src_topic").alias("name"))
    else:
        verdict = F.array(F.struct(F.lit("verdict").alias("kind"), F.col("decision").alias("name")))
        rules = F.transform("reasons", lambda r: F.struct(F.lit("rule").alias("kind"), r["rule"].alias("name")))
        kinds = decisions.select(F.explode(F.concat(verdict, rules)).alias("k")).select("k.*")
    folder = CommittedFolder(decisions.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        folder.write(batch.withColumn("batch", F.lit(number).cast("long")).coalesce(1), number)

    return kinds.groupBy("kind", "name").agg(F.count("*").alias("n")).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """kind, name, n as of the last batch."""
    rows = CommittedFolder(spark, path).read()
    return rows.groupBy("kind", "name").agg(F.max_by("n", "batch").alias("n"))
