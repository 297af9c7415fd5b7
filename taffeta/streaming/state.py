"""Running stateful queries: state in RocksDB, and the end of an input."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}

#: The event time of closing rows: later than any event's.
END = "timestamp_ntz'2250-01-01 00:00:00'"


@contextlib.contextmanager
def rocksdb(spark: SparkSession, partitions: int | None = None):
    """Queries started inside keep their state in RocksDB, on disk and changed by key, so that a micro-batch
    costs what its own rows do. ``partitions`` of state are fixed by a query's first start."""
    conf = _CONF | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def close_input(events: DataFrame, path: str, ts_col: str = "ts") -> None:
    """Ends a folder's stream: adds a file with one row without values whose event time is later than all, so
    that the watermark passes whatever is open. Events that come after it are late."""
    spark = events.sparkSession
    row = [(F.expr(END) if f.name == ts_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
    spark.range(1).select(*row).write.mode("append").parquet(path)


def run_available(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append", partitions: int | None = None) -> None:
    """Drive a streaming frame over everything available now into a Parquet sink."""
    with rocksdb(df.sparkSession, partitions):
        q = (df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start(out_path))
    q.awaitTermination()
