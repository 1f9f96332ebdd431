"""Derived files: CSV exports, partitioned tables, versioned snapshots with deltas."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.values import csv_line
from lakewright.operators import hashtree
from lakewright.operators.merge import apply_delta

MAX_DELTAS = 30
#: The column by which published tables are stored: the leaf of their hash tree.
LEAF = "_leaf"


def write_csv(df: DataFrame, path: str, order: list[Column]) -> None:
    """A CSV export: path/rows holds sorted part files, path/header one line; CRLF line ends, fields quoted only where they must be.

    The rows are sorted over all machines. Who wants one file joins the header and the parts in order of their names
    (`csv_files`); no task here sees more than its part.
    """
    put = lambda lines, name: lines.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/{name}")
    put(df.sparkSession.createDataFrame([(",".join(df.columns),)], "line string").coalesce(1), "header")
    put(df.sort(*order).select(csv_line(*map(F.col, df.columns)).alias("line")), "rows")


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The files of an export, in the order in which they make one file."""
    jvm = spark.sparkContext._jvm
    out = []
    for folder in ("header", "rows"):
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        out += sorted(f.getPath().toString() for f in files if f.getPath().getName().startswith("part-"))
    return out


def deck_text(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A list as text, one "3 Name" a line; a list has a bounded number of lines."""
    line = F.concat_ws(" ", F.col("quantity").cast("string"), "name")
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("text"))


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that df has rows of are replaced; rows of one meet before they are written."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


@dataclass
class Manifest:
    """What is published: a full snapshot and a chain of deltas that ends at it."""

    version: int
    schema: int
    deltas: list[tuple[int, int]] = field(default_factory=list)


def planned(published: Manifest | None, current: int, schema: int) -> tuple[bool, int | None]:
    """Whether there is nothing to do, and the version to make a delta from (None: no delta)."""
    same = published is not None and published.schema == schema
    if same and published.version == current:
        return True, None
    return False, published.version if same and published.version < current else None


def next_manifest(previous: Manifest | None, version: int, schema: int, base: int | None) -> Manifest:
    if base is None:
        return Manifest(version, schema)
    chain = previous.deltas if previous and previous.version == base else []
    return Manifest(version, schema, [*chain, (base, version)][-MAX_DELTAS:])


def unnamed(names: list[str], manifest: Manifest, previous: Manifest | None) -> list[str]:
    """Names to remove: all but the manifest's own, and the snapshot that a late reader of the last one may need."""
    keep = {f"v{manifest.version}", "manifest", *(f"v{a}-v{b}" for a, b in manifest.deltas)} | ({f"v{previous.version}"} if previous else set())
    return sorted(n for n in names if n not in keep)


class Snapshots:
    """Versions of a set of tables below one folder, on whatever file system Spark reads.

    A table is stored by the leaves of a hash tree over its keys, with the tree beside it, so a delta reads only where two
    versions differ. Columns may hold maps. An empty table has no file and can't be published.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], schema: int = 1):
        self.spark, self.root, self.keys, self.schema = spark, root.rstrip("/"), keys, schema

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def names(self) -> list[str]:
        fs, path = self._fs("")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self) -> Manifest | None:
        if "manifest" not in self.names():
            return None
        j = json.loads(self.spark.read.text(f"{self.root}/manifest").first()["value"])
        return Manifest(j["version"], j["schema"], [tuple(x) for x in j["deltas"]])

    def read(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{table}").drop(LEAF)

    def _tree(self, version: int, table: str) -> tuple[DataFrame, int]:
        held = self.spark.read.parquet(f"{self.root}/v{version}/{table}-tree").cache()
        return held, held.agg(F.max("level")).first()[0] or hashtree.DEPTH

    def _write(self, version: int, table: str, df: DataFrame, base: int | None) -> None:
        """A table by the leaves of its hash tree, and the tree; a version after another keeps its leaves."""
        keys, at = self.keys[table], f"{self.root}/v{version}/{table}"
        depth = self._tree(base, table)[1] if base is not None else hashtree.depth_for(df.count())
        marked = df.withColumn(LEAF, hashtree.leaf(keys, depth))
        # Ranges of leaves and keys, so that a large leaf is several files.
        marked.repartitionByRange(LEAF, *keys).sortWithinPartitions(LEAF, *keys).write.mode("overwrite").partitionBy(LEAF).parquet(at)
        hashtree.tree(self.read(f"v{version}", table), keys, depth).coalesce(1).write.mode("overwrite").parquet(f"{at}-tree")

    def _delta(self, base: int, version: int, table: str) -> DataFrame:
        """What turns one version into the next, from the leaves in which their trees differ."""
        (old_tree, depth), (new_tree, _) = self._tree(base, table), self._tree(version, table)
        stored = [self.spark.read.parquet(f"{self.root}/v{v}/{table}") for v in (base, version)]
        change = hashtree.tree_delta(*stored, old_tree, new_tree, self.keys[table], depth=depth, leaf_column=LEAF)
        old_tree.unpersist()
        new_tree.unpersist()
        return change

    def publish(self, version: int, tables: dict[str, DataFrame]) -> bool:
        """Writes a version, its delta from the published one, then the manifest; False if it is published already."""
        before = self.manifest()
        skip, base = planned(before, version, self.schema)
        if skip:
            return False
        for name, df in tables.items():
            self._write(version, name, df, base)
        if base is not None:
            for name in tables:
                self._delta(base, version, name).write.mode("overwrite").parquet(f"{self.root}/v{base}-v{version}/{name}")
        now = next_manifest(before, version, self.schema, base)
        self.spark.createDataFrame([(json.dumps(asdict(now)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest")
        for name in unnamed(self.names(), now, before):
            fs, path = self._fs(name)
            fs.delete(path, True)
        return True

    def caught_up(self, table: str, held: DataFrame, version: int) -> DataFrame:
        """A table at an older version, brought to the published one by the deltas between."""
        for a, b in self.manifest().deltas:
            if a >= version:
                held = apply_delta(held, self.read(f"v{a}-v{b}", table), self.keys[table])
        return held
