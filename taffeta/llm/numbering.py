"""Numbers for the rows of a table without a key of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taffeta.session import SCRATCH, bucketed, drop_shuffles, materialise, remove_scratch, scratch_path


def _numbers(docs: DataFrame) -> DataFrame:
    """The rows behind a number for each, which rises in the order of reading."""
    return docs.drop("_rid").select(F.monotonically_increasing_id().alias("_rid"), "*")


def numbered(docs: DataFrame) -> DataFrame:
    """Stores the rows with a number for each, ``_rid``, which is only read afterwards."""
    return materialise(_numbers(docs), "numbered")


def numbered_buckets(docs: DataFrame) -> DataFrame:
    """``numbered``, in buckets of ``_rid``: later joins on it don't shuffle the rows. The numbers are
    stored before they are shuffled, as a task that is run again could deal them out otherwise."""
    spark = docs.sparkSession
    path = scratch_path(spark, "numbered")
    _numbers(docs).write.options(**SCRATCH).parquet(path)
    out = bucketed(spark.read.parquet(path), "_rid", "numbered-buckets")
    remove_scratch(spark, path)
    drop_shuffles(spark)
    return out
