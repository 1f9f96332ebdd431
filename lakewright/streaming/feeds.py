"""Incremental reads and writes as streams.

Each job has a checkpoint in a folder that all machines share, so it goes on where it stopped; all end when the files
that were there at the start are read (trigger availableNow), so they also serve as batch jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.feed import latest


def read_files(spark: SparkSession, path: str, schema, per_batch: int = 100) -> DataFrame:
    """New Parquet files below a path, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Hands each batch to a function, until no input is left."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()


def append(stream: DataFrame, path: str, checkpoint: str) -> None:
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def once_per_day(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first observation of each key and day that arrives; later ones of that day are dropped within the watermark."""
    dated = stream.withWatermark(time, late).withColumn("day", F.to_date(time))
    return dated.dropDuplicatesWithinWatermark([*keys, "day"])


def daily_counts(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Counts by day and keys; a day comes out once the watermark has passed it."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.to_date("window.start").alias("day"), *keys, "n")


class LatestTable:
    """A table of the newest row of each key: a base and the batches since, each a folder of its own.

    A batch writes its own rows only. After COMPACT batches the base is written anew and what it holds is removed but
    for the base before, which a reader may still have open. A batch that comes again replaces itself.
    """

    COMPACT = 10

    def __init__(self, spark: SparkSession, root: str, schema, keys: list[str], time: str, tie: str):
        self.spark, self.root, self.schema, self.keys, self.time, self.tie = spark, root, schema, keys, time, tie

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """The numbers of whole bases (b) or batches (d)."""
        path, fs = self._fs()
        if not fs.exists(path(self.root)):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path(self.root)) if fs.exists(path(x.getPath(), "_SUCCESS"))]
        return sorted(int(n[1:]) for n in names if n[0] == kind)

    def _parts(self, before: int | None = None) -> tuple[int, list[int]]:
        """The last base (-1: none) and the batches since."""
        bases = [n for n in self._numbers("b") if before is None or n < before]
        base = bases[-1] if bases else -1
        return base, [n for n in self._numbers("d") if n > base and (before is None or n < before)]

    def current(self, before: int | None = None) -> DataFrame:
        base, batches = self._parts(before)
        read = lambda name, n: self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}{n}").withColumn("_batch", F.lit(n))
        parts = [read("b", n) for n in (base,) if n >= 0] + [read("d", n) for n in batches]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        if len(parts) == 1:
            return parts[0].drop("_batch")
        # An equally old row of a later batch replaces.
        return latest(reduce(DataFrame.unionAll, parts), self.keys, self.time, "_batch").drop("_batch").select(*self.schema.fieldNames())

    def merge(self, batch: DataFrame, number: int) -> None:
        """Combines the batch to a row for each key and writes it."""
        newest = latest(batch, self.keys, self.time, self.tie).select(*batch.columns)
        newest.write.mode("overwrite").parquet(f"{self.root}/d{number}")
        base, batches = self._parts()
        if len(batches) >= self.COMPACT:
            self.current().write.mode("overwrite").parquet(f"{self.root}/b{batches[-1]}")
            path, fs = self._fs()
            for kind, n in [("b", n) for n in self._numbers("b") if n < base] + [("d", n) for n in self._numbers("d") if n <= base]:
                fs.delete(path(f"{self.root}/{kind}{n}"), True)


def latest_wins(spark: SparkSession, stream: DataFrame, root: str, keys: list[str], time: str, tie: str) -> DataFrame:
    """The newest row of each key over the whole stream: a late observation never replaces a newer one."""
    table = LatestTable(spark, f"{root}/table", stream.schema, keys, time, tie)
    run(stream, f"{root}/checkpoint", table.merge)
    return table.current()
