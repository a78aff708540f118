"""Where lineage is cut: reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a session on this machine alone may go without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="larkspend-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and rereads it from the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A checkpoint of ``df`` in partitions of about ``rows`` rows or more, so that small tables don't make as many
    shuffle files as large ones."""
    kept = checkpoint(df)
    return kept.coalesce(max(1, -(-kept.count() // rows)))


def placed(docs: DataFrame, name: str = "__place") -> tuple[DataFrame, bool]:
    """``docs`` with a long of its own for each row, which grows with doc_id, null last; and whether that is the doc_id.

    Unique integer ids are their own places. Otherwise rows are sorted by id and a hash of the text once, and their
    places are kept with them in a checkpoint; the sort's last key is unique, so that rows which repeat can be split.
    """
    if isinstance(docs.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)):
        odd = docs.select("doc_id").groupBy("doc_id").count().where("count > 1 or doc_id is null")
        if not odd.head(1):
            return docs.withColumn(name, F.col("doc_id").cast("long")), True
    tie = f"{name}_tie"
    rows = docs.withColumn(tie, F.monotonically_increasing_id()).orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"), tie).drop(tie)
    return checkpoint(rows).withColumn(name, F.monotonically_increasing_id()), False
