"""The driver's Parquet tables. Reads are lazy: Catalyst prunes columns and pushes filters
into the scan of whichever table a query touches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (regexes over text) at least one partition per core.
    A scan of a small single-row-group file yields one partition; a large table yields far more
    partitions than cores and is left untouched (no shuffle)."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def load_table(spark: SparkSession, sf_dir: str, name: str, spread_small: bool = True) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if spread_small else df
