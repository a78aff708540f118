"""Event time, compacted tables, versioned lookups, schema evolution and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import symbol
from ..schemas import DEFAULTS, SYMBOLS


def with_event_time(records: DataFrame, event_time: str = "event_time", ingest_time: str = "ingest_time", partition: str = "src_partition", order: str = "seq", into: str = "ts", bucket_rows: int = 100_000) -> DataFrame:
    """Adds the record's time: its own if after the epoch, else when it was taken in if not before, else the latest
    time of its source partition so far. The running maximum is for batch inputs; streams always stamp the intake. It runs
    inside ranges of ``order`` (a long) and, over one row a range, before them, so no task sees a whole partition."""
    own = F.when(F.unix_millis(event_time) > 0, F.col(event_time))
    taken = F.when(F.unix_millis(ingest_time) >= 0, F.col(ingest_time))
    known = records.withColumn(into, F.coalesce(own, taken))
    if records.isStreaming:
        return known
    known = known.withColumn("__bucket", F.floor(F.col(order) / bucket_rows))
    before = Window.partitionBy(partition).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = known.groupBy(partition, "__bucket").agg(F.max(into).alias("__top")).withColumn("__before", F.max("__top").over(before)).drop("__top")
    inside = Window.partitionBy(partition, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (partition, "__bucket")]
    joined = known.withColumn("__inside", F.max(into).over(inside)).alias("a").join(tops.alias("b"), same[0] & same[1])
    return joined.select(*(F.col(f"a.{c}") for c in records.columns if c != into), F.coalesce(F.col(f"a.{into}"), F.greatest("__inside", "__before")).alias(into))


def latest(versions: DataFrame, key: str, order: str = "seq", live: str | None = None) -> DataFrame:
    """One row a key: its last version. With ``live``, a last version whose ``live`` column is null deletes the key.
    Versions are reduced before they are shuffled."""
    rest = [c for c in versions.columns if c != key]
    last = versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")
    return (last.where(F.col(live).isNotNull()) if live else last).select(*versions.columns)


def as_of(rows: DataFrame, versions: DataFrame, key: str, row_id: str, order: str = "seq") -> DataFrame:
    """``rows`` with the version of ``key`` that was current at each row's ``order``; null where there was none yet.

    Rows and versions of a key are merged in one sort, and the last version is carried forward: no pair of a row and a
    version is ever built.
    """
    rest = [c for c in versions.columns if c not in (key, order)]
    left = rows.select("*", F.lit(None).cast(StructType([versions.schema[c] for c in rest])).alias("__v"), F.lit(1).alias("__row"))
    names = rows.columns
    right = versions.select(*(F.col(c) if c in (key, order) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names), F.struct(*rest).alias("__v"), F.lit(0).alias("__row"))
    carried = F.last("__v", ignorenulls=True).over(Window.partitionBy(key).orderBy(order, "__row").rowsBetween(Window.unboundedPreceding, 0))
    return left.unionByName(right).withColumn("__v", carried).where("__row = 1").select(*names, *(F.col(f"__v.{c}").alias(c) for c in rest))


def evolve(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` of any older or newer version, read as ``schema``: missing columns are null, unknown ones are left out,
    and fields with a default have it."""
    there = set(rows.columns)
    columns = [F.col(f.name).cast(f.dataType) if f.name in there else F.lit(None).cast(f.dataType) for f in schema]
    out = rows.select(*(c.alias(f.name) for c, f in zip(columns, schema, strict=True)))
    for name, value in DEFAULTS.items():
        if name in out.columns:
            out = out.withColumn(name, symbol(name) if name in SYMBOLS else F.coalesce(name, F.lit(value)))
    return out


def read_versions(spark: SparkSession, paths, schema: StructType) -> DataFrame:
    """Parquet files of mixed versions read as ``schema``: the reader's schema is given, so a column that a file lacks is
    null and one that the schema lacks is never read; then defaults are filled in as ``evolve`` does."""
    return evolve(spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths)), schema)


def replay(rows: DataFrame, now_ms: int, t: str = "t", order: str = "seq") -> DataFrame:
    """All times moved by one offset, so that the first row in feed order lands at ``now_ms``."""
    first = rows.agg(F.min_by(t, order).alias("__first"))
    return rows.crossJoin(F.broadcast(first)).withColumn(t, F.col(t) + (F.lit(now_ms) - F.col("__first"))).drop("__first")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)
