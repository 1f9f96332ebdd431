"""A backfill that commits whole days and goes on where it was stopped.

Days are written aside, some at a time, and count only once a ledger names them: a ledger file is written whole or not
at all, and lists each day with its folder and its number of rows. Readers read what the ledger lists. A run that was
killed leaves folders that nothing names; the next one removes them and writes those days again, so no day is ever
there in part, or twice. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feeds import backfill_days

LEDGER = "day date, folder string, n long"


class DayTable:
    """Rows by day below one folder, on whatever file system Spark reads. schema: of the rows, with the column `day` (a date)."""

    def __init__(self, spark: SparkSession, root: str, schema):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._fs(name)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def ledger(self) -> DataFrame:
        """day, folder, n: what is committed."""
        # A folder of the ledger counts if its write has ended.
        whole = [f"{self.root}/ledger/{n}" for n in self._names("ledger") if "_SUCCESS" in self._names(f"ledger/{n}")]
        return self.spark.read.schema(LEDGER).parquet(*whole) if whole else self.spark.createDataFrame([], LEDGER)

    def rows(self) -> DataFrame:
        """All committed rows."""
        folders = [r["folder"] for r in self.ledger().select("folder").distinct().collect()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        listed = self.ledger().select("day", F.col("folder").alias("_folder"))
        read = lambda f: self.spark.read.schema(self.schema).parquet(f"{self.root}/days/{f}").withColumn("_folder", F.lit(f))
        every = read(folders[0])
        for f in folders[1:]:
            every = every.unionByName(read(f))
        return every.join(listed, ["day", "_folder"], "left_semi").select(*self.schema.fieldNames())

    def clean(self) -> list[str]:
        """Removes what no ledger names, and names it."""
        named = {r["folder"] for r in self.ledger().select("folder").distinct().collect()}
        lost = [("days", n) for n in self._names("days") if n not in named] + [("ledger", n) for n in self._names("ledger") if "_SUCCESS" not in self._names(f"ledger/{n}")]
        for kind, n in lost:
            fs, path = self._fs(f"{kind}/{n}")
            fs.delete(path, True)
        return [n for _, n in lost]

    def commit(self, rows: DataFrame, days: list) -> None:
        """Writes the rows of these days, then the ledger's lines, which make them count. A day without rows is committed too."""
        name = uuid.uuid4().hex
        mine = rows.where(F.col("day").isin(days))
        # In order of the days, so that a reader of some days skips the rest; a large day is dealt out by its rows.
        mine.repartitionByRange("day", F.xxhash64(*mine.columns)).sortWithinPartitions("day").write.parquet(f"{self.root}/days/{name}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.root}/days/{name}").groupBy("day").agg(F.count("*").alias("n"))
        asked = self.spark.createDataFrame([(d,) for d in days], "day date")
        lines = asked.join(written, "day", "left").select("day", F.lit(name).alias("folder"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        lines.coalesce(1).write.parquet(f"{self.root}/ledger/{name}")

    def backfill(self, spine: DataFrame, landed: DataFrame, rows: DataFrame, *, gaps: int = 3, at_a_time: int = 64, before_commit: Callable[[list], None] | None = None) -> int:
        """Commits the days that have landed and aren't there yet, until so many days in a row are missing; how many it committed.

        before_commit is called with the days of each commit, and may raise to stop the run.
        """
        self.clean()
        todo = backfill_days(spine, landed, self.ledger().select("day"), gaps)
        days = [r["day"] for r in todo.select("day").orderBy("day").collect()]
        for k in range(0, len(days), at_a_time):
            part = days[k : k + at_a_time]
            if before_commit:
                before_commit(part)
            self.commit(rows, part)
        return len(days)
