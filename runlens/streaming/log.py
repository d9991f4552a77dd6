"""An event log that a micro-batch reads in proportion to what it touches.

Events are written in segments, each partitioned into buckets by a hash of their key. A batch is a segment of level 0;
every ``FAN`` segments of a level are merged into one of the next level, with ``FAN`` times as many buckets. So buckets have about
the size of a batch's share whatever the level, a log of n batches has at most (FAN - 1) * log(n) segments, and every event is
rewritten once a level. A reader asks only the buckets of its keys.

Which segments are live follows from the number of batches alone (its digits in base ``FAN``), so there is no state beside
the files: a retried batch writes and merges into the same places. What a merge replaced is deleted a batch later, when the merge
can no longer be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments that are merged at a time; buckets of a batch; buckets that a reader lists before it takes whole segments.
FAN, BUCKETS, LISTED = 4, 16, 10_000


class EventLog:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, fan: int = FAN, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.fan, self.buckets = spark, path, key, schema, fan, buckets

    def segments(self, batches: int) -> list[tuple[int, int]]:
        """(level, first batch) of the live segments after so many batches, the oldest first."""
        found, at, level = [], 0, 0
        while self.fan ** (level + 1) <= batches:
            level += 1
        for x in range(level, -1, -1):
            while at + self.fan**x <= batches:
                found.append((x, at))
                at += self.fan**x
        return found

    def _folder(self, segment: tuple[int, int]) -> str:
        return f"{self.path}/level={segment[0]}/from={segment[1]}"

    def _bucket(self, level: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets * self.fan**level))

    def _write(self, rows: DataFrame, segment: tuple[int, int]) -> None:
        placed = rows.withColumn("_bucket", self._bucket(segment[0]))
        placed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self._folder(segment))

    def append(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch and merges what is due: batches are numbered from 0 without gaps."""
        self._forget(batch)
        self._write(rows.select(*self.schema.names), (0, batch))
        level = 0
        while (batch + 1) % self.fan ** (level + 1) == 0:
            first = batch + 1 - self.fan ** (level + 1)
            parts = [(level, first + i * self.fan**level) for i in range(self.fan)]
            self._write(self._read(parts, None), (level + 1, first))
            level += 1

    def _forget(self, batch: int) -> None:
        """Deletes what the batch before merged."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        level = 0
        while batch and batch % self.fan ** (level + 1) == 0:
            for i in range(self.fan):
                gone = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder((level, batch - self.fan ** (level + 1) + i * self.fan**level)))
                gone.getFileSystem(conf).delete(gone, True)
            level += 1

    def paths(self, segment: tuple[int, int], keys: set[int] | None) -> list[tuple[str, int]]:
        """(folder, bytes) of a segment's buckets, those that ``keys`` (buckets of the highest level so far) fall into."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(segment))
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        wanted = None if keys is None else {k % (self.buckets * self.fan ** segment[0]) for k in keys}
        found = []
        for status in fs.listStatus(top):
            name = status.getPath().getName()
            if name.startswith("_bucket=") and (wanted is None or int(name.split("=")[1]) in wanted):
                found.append((status.getPath().toString(), fs.getContentSummary(status.getPath()).getLength()))
        return found

    def _read(self, segments: list[tuple[int, int]], keys: set[int] | None) -> DataFrame:
        folders = [p for s in segments for p, _ in self.paths(s, keys)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def batch(self, batch: int) -> DataFrame:
        """The events of the batch appended last."""
        return self._read([(0, batch)], None)

    def buckets_of(self, ids: DataFrame, batches: int) -> set[int] | None:
        """The buckets of the ids at the highest level; None where they are more than a reader lists."""
        level = max((x for x, _ in self.segments(batches)), default=0)
        some = ids.select(self._bucket(level).alias("b")).distinct().limit(LISTED + 1).collect()
        return None if len(some) > LISTED else {r["b"] for r in some}

    def events_of(self, ids: DataFrame, batches: int) -> DataFrame:
        """All events of the ids (a column named like the key) in the first so many batches."""
        return self._read(self.segments(batches), self.buckets_of(ids, batches)).join(ids, self.key, "left_semi")

    def bytes_for(self, ids: DataFrame, batches: int) -> int:
        """Bytes that ``events_of`` reads."""
        keys = self.buckets_of(ids, batches)
        return sum(n for s in self.segments(batches) for _, n in self.paths(s, keys))
