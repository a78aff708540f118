"""The fold of cards with very many rows: days side by side, from guessed places, until every guess holds.

A card's fold is sequential, because a declined transaction doesn't move the card. For a feed in order of time, three things
cross from one day to the next: the attempts of the last ten minutes, which no verdict changes, so they are sent along; what
was spent, which ends with the day; and the last accepted place. That place is guessed: the last one of the days before, as
if it were accepted, which it mostly is. All days are folded at once, as tasks of their own; then each day's guess is
compared with what the last day that accepted any really left, and only days that started from a wrong place are folded
again. A day that is folded again mostly ends as before, as its own rows move the card, so few rounds are needed; after k of
them the first k days of a card are right in any case, so the result is that of the plain fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..policy import DAY_MS, TESTING_MS, Policy
from ..sources.shared import written
from .features import attempt_counts
from .kernel import Card, Row, step

_PLACE = ("last_lat", "last_lon", "last_seen", "last_place")
_FIELDS = ("t", "amount_minor", "merchant_id", "currency", "lat", "lon", "has_profile", "status", "daily_limit", "tier", "known", "country", "category", "attempts_60s")


def _same(columns, left: str, right: str):
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
    return out


def segments(rows: DataFrame) -> DataFrame:
    """``rows`` with ``seg``, the day (null for rows without a time), and ``context``: what a day's last ten minutes
    hold is sent to the next one too, to be counted there."""
    seg = F.floor(F.col("t") / DAY_MS)
    own = rows.withColumn("seg", seg).withColumn("context", F.lit(False))
    late = rows.where(F.col("t") >= (seg + 1) * DAY_MS - TESTING_MS).withColumn("seg", seg + 1).withColumn("context", F.lit(True))
    return own.unionByName(late)


def fold_segments(rows: DataFrame, starts: DataFrame, schema: StructType, passed: list[str], policy: Policy, name: str, evaluated_at_ms: int) -> DataFrame:
    """Decisions (``schema``, seg) of each segment of ``rows`` from the place in ``starts`` (card_id, seg, in_*)."""
    starts = starts.select(F.col("card_id").alias("__card"), F.col("seg").alias("__seg"), *(F.col(f"in_{c}") for c in _PLACE))
    joined = rows.join(starts, F.col("card_id").eqNullSafe(F.col("__card")) & F.col("seg").eqNullSafe(F.col("__seg"))).drop("__card", "__seg")
    placed = joined.repartition("card_id", "seg").sortWithinPartitions("card_id", "seg", "t", "txn_id")
    own = placed.columns
    at = {c: own.index(c) for c in own}
    reasons = schema["reasons"].dataType
    kinds = [pa.string(), pa.int32(), _arrow(reasons), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, card = object(), Card()
        for batch in batches:
            columns = [batch.column(at[c]).to_pylist() for c in ("card_id", "seg", "context", *(f"in_{c}" for c in _PLACE), *_FIELDS)]
            made, keep = [], []
            for k, (key, seg, context, lat, lon, seen, place, *fields) in enumerate(zip(*columns, strict=True)):
                if (key, seg) != now:
                    now, card = (key, seg), Card()
                    if seen is not None:
                        card.lat, card.lon, card.seen, card.place = lat, lon, seen, place
                row = Row(*fields)
                if context:
                    card.small.add(row.t, row.amount, row.merchant)
                    continue
                verdict, score, hits = step(card, row, policy)
                moved = card.seen is not None
                keep.append(k)
                made.append((verdict, score, [{"rule": r, "score": s, "detail": d} for r, s, d in hits], card.day, card.spent if card.day is not None else None, card.lat if moved else None, card.lon if moved else None, card.seen, card.place))
            rest = batch.take(pa.array(keep, pa.int64()))
            new = [pa.array([r[j] for r in made], k) for j, k in enumerate(kinds)]
            n = len(made)
            yield pa.RecordBatch.from_arrays([*(rest.column(at[c]) for c in passed), pa.array([name] * n, pa.string()), *new[:3], pa.array([evaluated_at_ms] * n, pa.int64()), *new[3:], rest.column(at["seg"])], [*schema.fieldNames(), "seg"])

    return placed.mapInArrow(fold, StructType(list(schema.fields)).add("seg", "long"))


def _arrow(reasons) -> pa.DataType:
    return pa.list_(pa.struct([("rule", pa.string()), ("score", pa.int32()), ("detail", pa.string())]))


def fold_hot(rows: DataFrame, schema: StructType, passed: list[str], policy: Policy, name: str, evaluated_at_ms: int) -> DataFrame:
    """Decisions of ``rows`` (flattened transactions of the cards to be cut, in order of t, txn_id), as the plain fold
    makes them."""
    cut = segments(rows)
    by_segment = cut.withColumn("__card", F.col("card_id")).withColumn("card_id", F.struct("card_id", "seg"))
    counted = written(attempt_counts(by_segment).withColumn("card_id", F.col("__card")).drop("__card"))

    # the guess: the last place of a day, carried over days that have none
    has = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("t").isNotNull() & ~F.col("context")
    place = F.struct(F.col("lat").alias("last_lat"), F.col("lon").alias("last_lon"), F.col("t").alias("last_seen"), F.when(F.col("known"), F.col("country")).alias("last_place"))
    last = counted.groupBy("card_id", "seg").agg(F.max_by(F.when(has, place), F.when(has, F.struct("t", "txn_id"))).alias("v"))
    days = Window.partitionBy("card_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("v", ignorenulls=True).over(days)
    starts = written(last.withColumn("v", before).select("card_id", "seg", *(F.col(f"v.{c}").alias(f"in_{c}") for c in _PLACE)))

    made = written(fold_segments(counted, starts, schema, passed, policy, name, evaluated_at_ms))
    at = F.col("card_id").eqNullSafe(F.col("__card")) & F.col("seg").eqNullSafe(F.col("__seg"))
    keyed = lambda df, *columns: df.select(F.col("card_id").alias("__card"), F.col("seg").alias("__seg"), *columns)
    while True:
        left = made.groupBy("card_id", "seg").agg(F.max_by(F.struct(*_PLACE), F.struct("t", "txn_id")).alias("out"))
        # a day that accepted no place leaves the one before it, so the last day that did counts
        own_place = F.when(F.floor(F.col("out.last_seen") / DAY_MS) == F.col("seg"), F.col("out"))
        left = left.withColumn("v", F.last(own_place, ignorenulls=True).over(days))
        out = keyed(left, *(F.col(f"v.{c}").alias(f"true_{c}") for c in _PLACE))
        wrong = starts.join(out, at).where(~_same(_PLACE, "in_", "true_") & F.col("seg").isNotNull())
        wrong = written(wrong.select("card_id", "seg", *(F.col(f"true_{c}").alias(f"in_{c}") for c in _PLACE)))
        if not wrong.head(1):
            break
        again = fold_segments(counted, wrong, schema, passed, policy, name, evaluated_at_ms)
        made = written(made.join(keyed(wrong), at, "left_anti").unionByName(again))
        starts = written(starts.join(keyed(wrong), at, "left_anti").unionByName(wrong))
    # what was spent on earlier days stands until a day's first accepted transaction
    order = Window.partitionBy("card_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    spent = made.groupBy("card_id", "seg").agg(F.max_by(F.struct("spend_day", "spent_minor"), F.struct("t", "txn_id")).alias("s"))
    spent = spent.withColumn("s", F.last(F.when(F.col("s.spend_day").isNotNull(), F.col("s")), ignorenulls=True).over(order))
    filled = made.join(keyed(spent, F.col("s.spend_day").alias("__day"), F.col("s.spent_minor").alias("__spent")), at)
    own = {"spent_minor": F.when(F.col("spend_day").isNotNull(), F.col("spent_minor")).otherwise(F.col("__spent")), "spend_day": F.coalesce("spend_day", "__day")}
    return filled.select(*(own.get(c, F.col(c)).alias(c) for c in schema.fieldNames()))
