"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taffeta.functions.text import py_split_ws
from taffeta.operators import metadata as M
from taffeta.operators.prefixes import prefix_pairs
from taffeta.operators.segment import segment_records
from taffeta.operators.sessions import _micros
from taffeta.sources.text import universal_newlines
from taffeta.streaming.state import run_available


def debounce_stream(events: DataFrame, key: str = "user_id", ts_col: str = "ts", value_col: str = "value",
                    tie: str = "event_id", gap_ms: int = 600, watermark: str = "10 seconds") -> DataFrame:
    """T1 on a stream: session windows per key; a session closes once the watermark passes its
    end, and append mode then emits its last value. The event time is made of the clock reading
    itself, whatever the session's time zone. Rows without a ``tie`` are closing rows (``close_input``);
    after one, every session has closed."""
    s = events.withColumn("_ts", F.timestamp_micros(_micros(ts_col))).withWatermark("_ts", watermark)
    g = s.groupBy(key, F.session_window("_ts", f"{gap_ms} milliseconds").alias("w"))
    return g.agg(F.min(ts_col).alias("session_start"), F.max(ts_col).alias("last_ts"),
                 F.count(tie).alias("n_events"),
                 F.max_by(value_col, F.struct("_ts", tie)).alias("last_value")).where("n_events > 0").drop("w")


def run_prefix_pairs(spark: SparkSession, corpus_dir: str, out_path: str, checkpoint: str,
                     max_file_age: str = "36500d", partitions: int | None = None) -> None:
    """Raw corpus files arriving in a folder -> records -> template -> prefix pairs in ``out_path``.
    The hashes of the records met so far are keyed state, looked up for a micro-batch's own records
    only; copies go however far apart they come and a late file is never lost. Pairs are cut after that,
    so state holds one hash for each record. Spark's file source would pass over files a week older than
    the newest; ``max_file_age`` lifts that."""
    raw = spark.readStream.option("maxFileAge", max_file_age).text(corpus_dir, wholetext=True)
    recs = segment_records(raw.select(universal_newlines("value").alias("value")), "value").where(F.col("text") != "")
    norm = M.template_records(recs).select(F.array_join(py_split_ws("templated"), " ").alias("templated"))
    new = norm.withColumn("hash", F.sha2("templated", 256)).dropDuplicates(["hash"])
    run_available(prefix_pairs(new, "templated", dedup=False), out_path, checkpoint, partitions=partitions)
