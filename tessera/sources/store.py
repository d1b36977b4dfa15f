"""Stored tables as snapshots: chunks, manifest and report, then a numbered pointer, which is the commit."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.schema import CHUNK, MANIFEST, REPORT, strict


class Store:
    """Chunk, manifest and report tables below root. A snapshot is a folder; the pointer with the greatest number names the one in force."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        """Names of the pointers, the one in force last: CURRENT, a number of fixed width, the snapshot."""
        if not self._fs().exists(self._path("")):
            return []
        found = (f.getPath().getName() for f in self._fs().listStatus(self._path("")))
        return sorted(name for name in found if name.startswith("CURRENT."))

    def current(self) -> str | None:
        pointers = self._pointers()
        return pointers[-1].split(".", 2)[2] if pointers else None

    def bootstrap(self) -> None:
        """Empty tables, unless there are some."""
        if self.current() is None:
            self.commit(*(self.spark.createDataFrame([], s) for s in (CHUNK, MANIFEST)))

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table of the current snapshot; empty before the first."""
        at = self.current()
        if at is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{at}/{name}")

    def chunks(self) -> DataFrame:
        return self.read("chunks", CHUNK)

    def report(self) -> DataFrame:
        """Seconds and error of each file of the build that made the snapshot."""
        return self.read("report", REPORT)

    def manifest(self) -> DataFrame:
        return self.read("manifest", MANIFEST)

    def commit(self, chunks: DataFrame, manifest: DataFrame, report: DataFrame | None = None) -> str:
        """Write the tables (checked against their schemas), then switch to them.

        A failed write changes nothing, and there is a snapshot in force at any time: the pointer is created, in one step,
        beside the older ones. Of two writers at once the second fails, as the number is taken.
        """
        name, number = f"snapshot-{uuid.uuid4().hex}", len(self._pointers()) + 1
        report = self.spark.createDataFrame([], REPORT) if report is None else report
        for part, df, schema in (("chunks", chunks, CHUNK), ("report", report, REPORT), ("manifest", manifest, MANIFEST)):
            strict(df, schema).write.parquet(f"{self.root}/{name}/{part}")
        taken = self._path("numbers", f"{number:012d}")
        self._fs().create(taken, False).close()
        self._fs().create(self._path(f"CURRENT.{number:012d}.{name}"), False).close()
        return name
