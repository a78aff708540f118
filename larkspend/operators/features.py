"""Attempt counts, for feeds in event-time order, and the rules that need no verdict."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..policy import HIGH_RISK, VELOCITY_MS
from .kernel import Small


def attempt_counts(rows: DataFrame, order: str = "txn_id") -> DataFrame:
    """Adds attempts_60s. Earlier attempts of the last minute come from a range frame, those of the same millisecond
    from their rank: a frame up to the current row would count later peers."""
    card = Window.partitionBy("card_id")
    before = F.count("*").over(card.orderBy("t").rangeBetween(-VELOCITY_MS, -1))
    return rows.withColumn("attempts_60s", before + F.row_number().over(Window.partitionBy("card_id", "t").orderBy(order)))


def small_attempts(rows: DataFrame, order: str = "txn_id") -> DataFrame:
    """Adds small_10m and small_merchants_10m: attempts below the testing amount in the last ten minutes, this one
    included, and their merchants. One pass over each card's rows in order of time with a sliding count, so that a burst on
    one card costs no more than its rows."""
    names = rows.columns
    card, t, amount, merchant = (names.index(c) for c in ("card_id", "t", "amount_minor", "merchant_id"))

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, small = object(), Small()
        for batch in batches:
            out = []
            for key, *row in zip(*(batch.column(j).to_pylist() for j in (card, t, amount, merchant)), strict=True):
                if key != now:
                    now, small = key, Small()
                out.append(small.add(*row) if row[0] is not None else (0, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[j] for x in out], pa.int64()) for j in (0, 1))], [*names, "small_10m", "small_merchants_10m"])

    schema = StructType(list(rows.schema.fields)).add("small_10m", "long").add("small_merchants_10m", "long")
    return rows.repartition("card_id").sortWithinPartitions("card_id", "t", order).mapInArrow(slide, schema)


def risk_category(merchant: str = "merchant", transaction: str = "transaction") -> Column:
    """The merchant's category, or what the transaction says where the merchant is unknown."""
    return F.when(F.col(merchant).isNotNull(), F.col(f"{merchant}.mcc")).otherwise(F.col(f"{transaction}.category"))


def static_rules(enriched: DataFrame) -> DataFrame:
    """transaction_id and the rules that depend on reference data alone."""
    return enriched.select(
        F.col("transaction.transaction_id").alias("transaction_id"),
        F.col("card_profile").isNull().alias("unknown_card"),
        F.coalesce(F.col("card_profile.status") != "ACTIVE", F.lit(False)).alias("card_not_active"),
        F.coalesce(risk_category().isin(*HIGH_RISK), F.lit(False)).alias("merchant_risk"),
    )
