"""Exact global ranks without a single-partition window.

``orderBy`` range-partitions and sorts; partition i then holds only keys below those of i+1.
Each row's rank is (rows in earlier partitions) + (position within its partition). The sorted
frame, with its partition id and in-partition position, is written once as a table below the
shared checkpoint folder (one computation, lineage cut), so the per-partition counts and the
rows come from the same materialisation; the offsets table has one row per partition and is
broadcast (its size is the partition count, not the data size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taffeta.session import scratch_path

#: Leading bytes of a digest that rows are grouped by: at most 65,536 groups.
LEADING = 2


def global_rank(df: DataFrame, order_cols, out: str = "rank") -> DataFrame:
    """1-based rank of every row in the given total order (ties keep an arbitrary order)."""
    spark = df.sparkSession
    path = scratch_path(spark, "rank")
    (df.orderBy(*order_cols)
       .withColumn("_pid", F.spark_partition_id())
       .withColumn("_mid", F.monotonically_increasing_id())
       .write.parquet(path))
    s = spark.read.parquet(path)
    parts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranked = s.join(F.broadcast(parts.select("_pid", "_off", "_m0")), "_pid")
    return ranked.withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_m0")) + 1) \
                 .drop("_pid", "_mid", "_off", "_m0")


def hashed_rank(df: DataFrame, digest: str, out: str = "rank") -> DataFrame:
    """1-based rank of every row in the order of a binary digest column (ties keep an arbitrary order), with the
    group that the row was sorted in (``_group``, ``_before`` rows lie ahead of it, ``_size`` in it) and whether
    the row before it in the group has the same digest (``_again``). Digests are
    even, so rows are grouped by the first bytes and sorted within, by the others; how many lie before a group follows
    from counts, a broadcast of at most 65,536 rows. Nothing is stored, ``df`` is made twice (the first time for the
    counts, as a range shuffle would for its sample) and must be deterministic."""
    others = [c for c in df.columns if c != digest]
    d = df.select(*others, F.substring(digest, 1, LEADING).alias("_group"), F.substring(digest, LEADING + 1, 1 << 30).alias("_tail"))
    sizes = d.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    place = Window.partitionBy("_group").orderBy("_tail")
    ranked = d.withColumns({out: F.row_number().over(place), "_again": F.lag("_tail").over(place) == F.col("_tail")})
    # null safe: rows without a digest are a group of their own, the first
    sizes = sizes.withColumnRenamed("_group", "_of")
    return ranked.join(F.broadcast(sizes), F.col("_group").eqNullSafe(F.col("_of"))).drop("_of") \
                 .withColumns({out: F.col(out) + F.col("_before"), digest: F.concat("_group", "_tail")}).drop("_tail")
