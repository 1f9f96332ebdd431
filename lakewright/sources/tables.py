"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: dealt out by the key and sorted, never broadcast.

    Spark decides by the size of the files, which hold each different value once; the rows can be a hundred times larger.
    """
    return side.hint("merge")
