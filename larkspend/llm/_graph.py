"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import checkpoint, compact


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around their smallest ids; ``compact`` bounds a partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    ends = [(x, find(x)) for x in root]
    ends = [(x, y) for x, y in ends if x != y]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([y for _, y in ends], pa.int64())], ["a", "b"])


def components(edges: DataFrame, rows: int = 100_000) -> DataFrame:
    """(id, component): the smallest id that each end of an edge of ``edges`` (a, b) reaches, for ids with an edge.

    First each partition, of about ``rows`` edges, turns its own into stars; several partitions then exchange theirs.

    Every step hooks each node's larger neighbours (then its smaller ones) to its smallest neighbour, so that edges
    turn into stars in a logarithmic number of steps. Minima are pre-aggregated and kept in checkpoints; so the joins back
    are plain equi-joins whose hot keys adaptive execution can split. Nothing but two numbers a step reaches the driver.
    """
    now = compact(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), rows)
    alone = now.rdd.getNumPartitions() == 1
    now = checkpoint(now.mapInArrow(_contract, "a long, b long"))
    state = None
    while not alone:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = checkpoint(both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        hooked = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = checkpoint(hooked.union(low.select("a", F.col("m").alias("b"))).distinct())
        size = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 31)), F.lit(0))).first()
        if tuple(size) == state:
            break
        state = tuple(size)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
