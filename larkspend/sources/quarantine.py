"""Undecodable records are set aside with their bytes and origin; good ones go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import shorten
from .committed import CommittedFolder


def parse(records: DataFrame, schema: StructType) -> DataFrame:
    """``records`` with ``__p``, the record of the schema, ``__broken``, and ``__why`` where it is bad."""
    reader = StructType([*schema.fields]).add("_corrupt_record", "string")
    text = F.col("value").cast("string")
    parsed = records.withColumn("__p", F.from_json(text, reader, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    missing = F.concat_ws(", ", *(F.when(F.col(f"__p.{f.name}").isNull(), F.lit(f.name)) for f in schema if not f.nullable))
    parsed = parsed.withColumn("__broken", F.col("__p").isNull() | F.col("__p._corrupt_record").isNotNull())
    return parsed.withColumn("__why", F.when(F.col("__broken"), F.concat(F.lit("not a record of the schema; caused by: "), F.coalesce(text, F.lit("null")))).when(missing != "", F.concat(F.lit("required fields are missing: "), missing)))


def parted(parsed: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of parsed records."""
    good = parsed.where("__why is null").select("key", *(F.col(f"__p.{f.name}").alias(f.name) for f in schema), "src_partition", "src_offset")
    bad = parsed.where("__why is not null").select(
        "key", "value", *(c for c in parsed.columns if c == "headers"), "src_topic", "src_partition", "src_offset", "src_timestamp", F.when(F.col("__broken"), F.lit("MalformedRecord")).otherwise(F.lit("MissingField")).alias("exception_class"), shorten(F.col("__why")).alias("message"), F.spark_partition_id().cast("string").alias("task_id"),
    )
    return good, bad


def split(records: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of records (key, value bytes, src_topic, src_partition, src_offset, src_timestamp, and headers where the
    source has them); bad ones keep key, bytes and headers.

    A value is bad if it isn't JSON of the schema or lacks a required field. Both sides are filters over one parse.
    """
    return parted(parse(records, schema), schema)


def writer(schema: StructType, write_bad: Callable[[DataFrame, int], None], write_good: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: bad rows first, so that a failing quarantine stops the job before its offsets commit. A batch
    is parsed once for both. Both get the batch's number, with which ``CommittedFolder.write`` writes it once."""

    def run(batch: DataFrame, number: int) -> None:
        parsed = parse(batch, schema).persist()
        try:
            good, bad = parted(parsed, schema)
            write_bad(bad, number)
            write_good(good, number)
        finally:
            parsed.unpersist()

    return run


def split_stream(records: DataFrame, schema: StructType, path: str, checkpoint: str):
    """A writer of a stream's good records under ``path``/good and its bad ones under ``path``/bad, each batch once."""
    spark = records.sparkSession
    bad, good = CommittedFolder(spark, f"{path}/bad"), CommittedFolder(spark, f"{path}/good")
    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(writer(schema, bad.write, good.write))
