"""State tables that keep their partitioning: joins and upserts on the key leave the stored side where it lies.

A table is cut into segments by a hash of its key, and each segment into Spark's buckets by the key. A version is a list of segment folders in the
commits of `tables`; it is opened as a bucketed table whose partitions are those folders, so Spark knows how the rows are dealt and sorted, in any session. An
upsert reads and writes the segments that its batch touches; the others' folders go into the next version as they are. Two writers: as with every commit, the one whose
table has changed since it read computes anew.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.sources.tables import Conflict, publish, read_commit

SEGMENT = "_segment"


@dataclass(frozen=True)
class BucketedTable:
    """A state table under path. schema: DDL; segments bound what an upsert rewrites, buckets the tasks of a join."""

    spark: SparkSession
    path: str
    name: str
    schema: str
    key: str
    segments: int = 64
    buckets: int = 16

    def _segment(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.segments)).cast("int")

    def folders(self) -> dict[str, str]:
        """Folder of each segment in the newest version; segments without rows have none."""
        return read_commit(self.spark, self.path).get(self.name) or {}

    def _opened(self, folders: dict[str, str]) -> DataFrame:
        """Folders as one bucketed table of the session's catalog, which holds names only: the data is external."""
        said = f"{self.path}|{self.name}|{self.schema}|{self.buckets}|{sorted(folders.items())}".encode()
        table = f"state_{zlib.crc32(said):08x}_{zlib.adler32(said):08x}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(
                f"CREATE TABLE {table} ({self.schema}, {SEGMENT} INT) USING parquet PARTITIONED BY ({SEGMENT}) CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS"
                f" LOCATION '{self.path}/{self.name}/none'"
            )
            if folders:
                parts = " ".join(f"PARTITION ({SEGMENT}={n}) LOCATION '{self.path}/{f}'" for n, f in sorted(folders.items()))
                self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")
        return self.spark.table(table)

    def read(self) -> DataFrame:
        """The newest version; joins and groupings on the key need no exchange of it."""
        return self._opened(self.folders()).drop(SEGMENT)

    def _write(self, df: DataFrame) -> dict[str, str]:
        """Write rows in segments and buckets; the folder of each segment that got rows."""
        folder, table = f"{self.name}/data={uuid.uuid4().hex}", f"draft_{uuid.uuid4().hex}"
        columns = self._opened({}).drop(SEGMENT).columns
        rows = df.select(*columns, self._segment().alias(SEGMENT))
        rows.write.format("parquet").partitionBy(SEGMENT).bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{folder}").saveAsTable(table)
        found = [r[0] for r in self.spark.table(table).select(SEGMENT).distinct().collect()]  # as many as there are segments
        self.spark.sql(f"DROP TABLE {table}")
        return {str(n): f"{folder}/{SEGMENT}={n}" for n in found}

    def replace(self, df: DataFrame) -> int:
        """A first version, or one that keeps nothing of the last."""
        before = read_commit(self.spark, self.path).get(self.name)
        return publish(self.spark, self.path, {self.name: self._write(df.repartition(self.buckets, self.key))}, {self.name: before})

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], attempts: int = 5) -> int:
        """merge(old, new), over the segments that new touches; old keeps its partitioning. merge may add rows of new's keys and change or drop old ones."""
        touched = {str(r[0]) for r in new.select(self._segment().alias("n")).distinct().collect()}  # as many as there are segments
        for attempt in range(attempts):
            before = read_commit(self.spark, self.path).get(self.name)
            held = before or {}
            old = self._opened({n: f for n, f in held.items() if n in touched}).drop(SEGMENT)
            written = self._write(merge(old, new))
            try:
                return publish(self.spark, self.path, {self.name: {n: f for n, f in held.items() if n not in touched} | written}, {self.name: before})
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise Conflict("too many writers")
