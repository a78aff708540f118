"""Batches that are written once: what a stream writes with ``foreachBatch`` and another stream reads as files.

A batch's rows are first written aside. Its manifest, which lists these files, then is put in place by one rename: from
there on the batch is decided. Files are moved into the feed under names made of batch and position, so moving goes on where it
stopped, and a batch that is run again finds its manifest and writes nothing. A batch without one has published nothing.
So the feed's readers see each row once, whenever a run ends.

Folders are reached through Hadoop's file systems, so they can be anywhere that Spark writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class CommittedFolder:
    """``path``/feed holds the rows of all committed batches, ``path``/commits a manifest for each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.feed = spark, path, f"{path}/feed"

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), lambda x: jvm.org.apache.hadoop.fs.Path(x)

    def manifest(self, number: int) -> dict | None:
        fs, at = self._fs()
        name = at(f"{self.path}/commits/{number}.json")
        if not fs.exists(name):
            return None
        stream = fs.open(name)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        """The committed batches, in order."""
        fs, at = self._fs()
        folder = at(f"{self.path}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def write(self, rows: DataFrame, number: int, info: dict | None = None) -> bool:
        """Writes a batch unless it is committed already; either way its files are in the feed afterwards. ``info`` is
        kept in the manifest. False if the batch was committed before."""
        if self.manifest(number) is not None:
            self.publish(number)
            return False
        aside = f"{self.path}/aside/{number}-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        self.commit(number, aside, info)
        self.publish(number)
        return True

    def commit(self, number: int, aside: str, info: dict | None = None) -> None:
        fs, at = self._fs()
        files = sorted(s.getPath().getName() for s in fs.listStatus(at(aside)) if s.getPath().getName().startswith("part-"))
        made = at(f"{self.path}/commits/.{number}-{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(bytearray(json.dumps({"aside": aside, "files": files, "info": info or {}}).encode()))
        out.close()
        # a rename onto a file that there is fails: only one run of a batch is the committed one
        if not fs.rename(made, at(f"{self.path}/commits/{number}.json")):
            fs.delete(made, False)

    def publish(self, number: int) -> None:
        fs, at = self._fs()
        found = self.manifest(number)
        fs.mkdirs(at(self.feed))
        for k, name in enumerate(found["files"]):
            to = at(f"{self.feed}/batch-{number:010d}-{k:05d}.parquet")
            if not fs.exists(to):
                fs.rename(at(f"{found['aside']}/{name}"), to)
        fs.delete(at(found["aside"]), True)

    def files(self, number: int) -> list[str]:
        """Where a committed batch's rows are."""
        return [f"{self.feed}/batch-{number:010d}-{k:05d}.parquet" for k in range(len(self.manifest(number)["files"]))]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.feed)

    def stream(self, schema: StructType, **options) -> DataFrame:
        """The feed as a stream, in order of batches as far as a file stream has one."""
        return self.spark.readStream.schema(schema).options(**options).parquet(self.feed)
