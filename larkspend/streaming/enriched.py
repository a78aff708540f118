"""The enrichment stream: reference data is read anew for every micro-batch, so changes reach later transactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.enrich import enrich
from ..sources.committed import CommittedFolder


def enrich_stream(transactions: DataFrame, profiles: Callable[[], DataFrame], merchants: Callable[[], DataFrame], path: str, checkpoint: str):
    """A writer of enriched transactions, each micro-batch committed once (``CommittedFolder``): a batch that is repeated
    after a failure adds nothing that the next stream has seen. ``profiles`` and ``merchants`` are called once a batch
    (``sources.tables.latest`` gives the last version of each, ``streaming.profiles`` keeps profiles up to date)."""
    folder = CommittedFolder(transactions.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        folder.write(enrich(batch, profiles(), merchants()), number)

    return transactions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def read_enriched(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The enriched feed as a stream, as the decision stream reads it."""
    return CommittedFolder(spark, path).stream(schema)
