"""Current tables: the newest row of every key, written as small deltas and merged when they are read.

A table is a folder of versions. A delta holds the rows one micro-batch or job has changed, a base all rows as of its version;
both are divided into buckets by a hash of the bucket columns, so a reader that knows its keys opens their buckets only. Once
enough deltas have gathered they are compacted into a new base, so the number of files stays bounded. Versions are written in
overwrite mode and rise: a repeated batch replaces itself, and reads what was there before it. A table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, BUCKET = "_version", "_bucket"


@dataclass(frozen=True)
class CurrentTable:
    """keys: columns that name a row. by: bucket columns, a part of the keys (all of them by default). retain: a timestamp
    column; compaction drops rows that lie more than `retain_hours` before the newest of all."""

    spark: SparkSession
    path: str
    keys: Sequence[str]
    by: Sequence[str] = ()
    buckets: int = 16
    deltas: int = 8
    retain: str | None = None
    retain_hours: float = 48.0

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in (self.by or self.keys)]), F.lit(self.buckets)).cast("int")

    def _files(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, kind: str) -> list[int]:
        """Finished versions: one listing of the table's own folder."""
        hadoop, files = self._files()
        if not files.exists(hadoop):
            return []
        found = [s.getPath() for s in files.listStatus(hadoop) if s.getPath().getName().startswith(f"{kind}=")]
        done = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _has_rows(self, kind: str, version: int) -> bool:
        hadoop, files = self._files()
        inside = files.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(hadoop, f"{kind}={version}"))
        return any(f.getPath().getName().startswith(BUCKET) for f in inside)

    def next_version(self) -> int:
        return max([-1, *self.versions("delta"), *self.versions("base")]) + 1

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{kind}={version}")

    def upsert(self, rows: DataFrame, version: int) -> None:
        """Put rows in as the newest of their keys; at most one row a key."""
        self._write(rows, "delta", version)
        base = max([v for v in self.versions("base") if v < version], default=-1)
        if sum(base < v <= version for v in self.versions("delta")) >= self.deltas:
            self.compact(version)

    def read(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame | None:
        """The newest row of every key among the versions below `before` (all by default), or None if there are none.

        `touched` has the bucket columns of the rows the reader wants: only their buckets are opened, at most `buckets` numbers
        come to the driver for that.
        """
        limit = 1 << 62 if before is None else before
        base = max([v for v in self.versions("base") if v < limit], default=None)
        parts = [("base", base)] if base is not None else []
        parts += [("delta", v) for v in self.versions("delta") if v < limit and (base is None or v > base)]
        parts = [p for p in parts if self._has_rows(*p)]
        if not parts:
            return None
        wanted = None
        if touched is not None:
            wanted = [r[0] for r in touched.select(self._bucket().alias(BUCKET)).distinct().collect()]
        merged = None
        for kind, version in parts:
            rows = self.spark.read.parquet(f"{self.path}/{kind}={version}")
            if wanted is not None:
                rows = rows.filter(F.col(BUCKET).isin(*wanted))
            rows = rows.withColumn(VERSION, F.lit(version))
            merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
        if touched is not None:
            by = list(self.by or self.keys)
            merged = merged.join(touched.select(*by).distinct(), by, "left_semi")
        rest = [c for c in merged.columns if c not in (*self.keys, VERSION, BUCKET)]
        newest = merged.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), VERSION).alias("_row"))
        return newest.select(*self.keys, *[F.col(f"_row.{c}").alias(c) for c in rest])

    def compact(self, version: int) -> None:
        """A new base as of `version`. The base before it and what followed that one stay until the next compaction, so a batch
        that is repeated still finds the table as it was."""
        rows = self.read(before=version + 1)
        if rows is None:
            return
        if self.retain is not None:
            newest: datetime | None = rows.agg(F.max(self.retain)).first()[0]
            if newest is not None:
                rows = rows.filter(F.col(self.retain) > F.lit(newest) - F.make_dt_interval(mins=F.lit(int(self.retain_hours * 60))))
        last = max([v for v in self.versions("base") if v < version], default=None)
        self._write(rows, "base", version)
        if last is not None:
            hadoop, files = self._files()
            old = [f"delta={v}" for v in self.versions("delta") if v <= last] + [f"base={v}" for v in self.versions("base") if v < last]
            for name in old:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(hadoop, name), True)
