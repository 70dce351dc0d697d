"""Append-only rows by key: segments, bucketed and sorted by the key and merged in levels."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from jobforge.functions.session import num_partitions, remove, tidy

#: Rows a bucket is meant to hold, the least and the most buckets of a segment, and segments of a level that are merged into one.
BUCKET, LEAST_BUCKETS, MOST_BUCKETS, FAN = 1 << 19, 4, 1 << 13, 6


class Segments:
    """Segments under ``path``, named by ``name``, of rows of ``schema`` (name -> SQL type) by ``key``. A segment is [folder, buckets, rows, level]; which ones
    count is for the owner's manifest to say, so nothing here is ever overwritten."""

    def __init__(self, spark: SparkSession, path: str, name: str, schema: dict[str, str], key: tuple[str, ...], fan: int = FAN):
        self.spark, self.path, self.name, self.schema, self.key, self.fan = spark, path, name, schema, key, fan

    def write(self, rows: DataFrame, n: int, level: int = 0) -> list:
        """A new segment of ``n`` rows or so; its number of buckets follows the volume, but isn't below the session's shuffle width, or else joins would
        shuffle both sides for parallelism's sake. Sorted keys are kept as differences."""
        buckets, wide = LEAST_BUCKETS, num_partitions(self.spark)
        while (buckets * BUCKET < n and buckets < MOST_BUCKETS) or buckets < wide:
            buckets *= 2
        at, made = f"{self.name}-{uuid.uuid4().hex[:12]}", f"written_{uuid.uuid4().hex[:12]}"
        with tidy(self.spark):
            out = rows.select(*self.schema).repartition(buckets, *self.key).write.bucketBy(buckets, *self.key).sortBy(*self.key).option("path", f"{self.path}/{at}")
            out.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v2").format("parquet").saveAsTable(made)
        self.spark.sql(f"DROP TABLE {made}")  # the files stay
        return [at, buckets, n, level]

    def table(self, segment: list) -> DataFrame:
        """A segment as a bucketed table, so that a join on the key moves the other side alone."""
        at, buckets, *_ = segment
        name, key = self._table(segment), ", ".join(self.key)
        if not self.spark.catalog.tableExists(name):
            cols = ", ".join(f"{c} {t}" for c, t in self.schema.items())
            self.spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{self.path}/{at}'")
        return self.spark.table(name)

    def _table(self, segment: list) -> str:
        return f"{self.name}_{segment[0].rsplit('-', 1)[1]}"

    def scan(self, segments: list[list]) -> DataFrame:
        """All rows of some segments, in one scan."""
        return self.spark.read.schema(", ".join(f"{c} {t}" for c, t in self.schema.items())).parquet(*(f"{self.path}/{s[0]}" for s in segments))

    def merged(self, segments: list[list]) -> tuple[list[list], list[list]]:
        """The segments after those of each level that has FAN of them were merged into one of the next, and those that are of no use any more."""
        gone, level = [], 0
        while len(own := [s for s in segments if s[3] == level]) >= self.fan:
            made = self.write(reduce(DataFrame.unionByName, [self.table(s) for s in own]), sum(s[2] for s in own), level + 1)
            segments = [s for s in segments if s not in own] + [made]
            gone += own
            level += 1
        return segments, gone

    def forget(self, segment: list, files: bool = True) -> None:
        """Drop a segment's table, and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(segment)}")
        if files:
            remove(self.spark, f"{self.path}/{segment[0]}")
