"""The corpus pipeline: toxicity, line de-duplication, near-duplicate removal, mixing, encoding.

Each stage works on all that the one before it kept; ``run`` writes each stage's rows as Parquet
below the shared checkpoint folder and reads them again.

Defined cases: the operators' own (see their modules). A document whose text line de-duplication
empties goes with that stage, as nothing is left of it; one that was empty before stays. n_chars
follows a shortened text. A document that the mix takes twice comes twice.

A stage's result must be stored before the next stage is called, as ``run`` does: each stage first
deletes the intermediates of the one that its thread called before.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taffeta.llm import bpe, lines, minhash, mixing, toxicity
from taffeta.llm.batches import small_batches
from taffeta.llm.numbering import numbered_buckets
from taffeta.session import drop_shuffles, materialise, remove_scratch, scratch_made

_before = threading.local()


def _stage(f):
    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in getattr(_before, "paths", []):
            remove_scratch(spark, path)
        drop_shuffles(spark)
        small_batches(spark)
        made = len(scratch_made())
        out = f(spark, docs, sf_dir)
        _before.paths = scratch_made()[made:]
        return out

    return call


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.withColumn("_text", F.col("text")), model, text="_text", out="_score", restored=None)
    return scored.where(F.col("_score") < 0.5).select(*docs.columns)


@_stage
def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    out = lines.dedup_lines(spark, docs.withColumn("_was", size)).withColumn("_is", size)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_is") < F.col("_was"), F.col("_is")).otherwise(F.col("n_chars")))
    return out.where("_was = 0 or _is > 0").select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered_buckets(docs)
    groups = minhash.near_duplicates(spark, rows)
    return rows.join(minhash.one_of_each(groups), "_rid").select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    # executors come here with heaps that the stages before have filled
    coded = bpe.encode(docs.select("doc_id", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN,
                       remembered=100_000, block_chars=1 << 20)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", delete_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: No stage can be told in SQL; tests look at columns, counts and the round trip, and at the operators alone.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
