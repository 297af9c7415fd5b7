"""Decoding-strategy dimension (S11) and the joins that use it.

The dimension is a fixed 29-row table, so broadcasting it is size-bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAM_FIELDS = ("do_sample", "num_beams", "early_stopping", "no_repeat_ngram_size",
                "temperature", "top_k", "top_p")

PARAMS_TYPE = T.StructType([
    T.StructField("do_sample", T.BooleanType()),
    T.StructField("num_beams", T.IntegerType()),
    T.StructField("early_stopping", T.BooleanType()),
    T.StructField("no_repeat_ngram_size", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("top_p", T.DoubleType()),
])

# The strategy table as executed, in definition order.
# (name, canonical, do_sample, num_beams, early_stopping, no_repeat_ngram_size, temperature, top_k, top_p)
STRATEGIES = (
    ("GREEDY", "GREEDY", False, 1, None, None, None, None, None),
    ("BEAM_SEARCH", "BEAM_SEARCH", False, 5, True, None, None, None, None),
    ("BEAM_SEARCH_N_GRAM", "BEAM_SEARCH_N_GRAM", False, 5, True, 2, None, None, None),
    ("TEMP_085", "TEMP_085", True, 1, None, None, 0.85, 0, None),
    ("TEMP_095", "TEMP_095", True, 1, None, None, 0.95, 0, None),
    ("TEMP_105", "TEMP_105", True, 1, None, None, 1.05, 0, None),
    ("TEMP_125", "TEMP_125", True, 1, None, None, 1.25, 0, None),
    ("TEMP_150", "TEMP_150", True, 1, None, None, 1.5, 0, None),
    ("TEMP_175", "TEMP_175", True, 1, None, None, 1.75, 0, None),
    ("TEMP_200", "TEMP_200", True, 1, None, None, 2.0, 0, None),
    ("TOP_K5", "TOP_K5", True, 1, None, None, None, 5, None),
    ("TOP_K50", "TOP_K50", True, 1, None, None, None, 50, None),
    ("TOP_K100", "TOP_K100", True, 1, None, None, None, 100, None),
    ("TOP_K50_T125", "TEMP_125", True, 1, None, None, 1.25, 0, None),
    ("TOP_K150_T150", "TEMP_150", True, 1, None, None, 1.5, 0, None),
    ("TOP_K175_T175", "TEMP_175", True, 1, None, None, 1.75, 0, None),
    ("TOP_P88", "TOP_P88", True, 1, None, None, None, 0, 0.88),
    ("TOP_P92", "TOP_P92", True, 1, None, None, None, 0, 0.92),
    ("TOP_P96", "TOP_P96", True, 1, None, None, None, 0, 0.96),
    ("TOP_P98", "TOP_P98", True, 1, None, None, None, 0, 0.98),
    ("TOP_P99", "TOP_P99", True, 1, None, None, None, 0, 0.99),
    ("TOP_P200", "TOP_P200", True, 1, None, None, None, 0, 2.0),
    ("TOP_P92_T125", "TOP_P92_T125", True, 1, None, None, 1.25, 0, 0.92),
    ("TOP_P92_T150", "TOP_P92_T150", True, 1, None, None, 1.5, 0, 0.92),
    ("TOP_P92_T175", "TOP_P92_T175", True, 1, None, None, 1.75, 0, 0.92),
    ("TOP_KP", "TOP_P92", True, 1, None, None, None, 0, 0.92),
    ("TOP_KP_T125", "TOP_P92_T125", True, 1, None, None, 1.25, 0, 0.92),
    ("TOP_KP_T150", "TOP_P92_T150", True, 1, None, None, 1.5, 0, 0.92),
    ("TOP_KP_T175", "TOP_P92_T175", True, 1, None, None, 1.75, 0, 0.92),
)

CANONICAL = tuple(r[0] for r in STRATEGIES if r[0] == r[1])

CATALOG_SCHEMA = T.StructType([T.StructField("name", T.StringType(), False),
                               T.StructField("canonical", T.StringType(), False),
                               *PARAMS_TYPE.fields])


def strategy_catalog(spark: SparkSession) -> DataFrame:
    """Name -> canonical name and hyper-parameters (aliases included)."""
    return spark.createDataFrame(list(STRATEGIES), CATALOG_SCHEMA)


def params_col(prefix: str = "") -> F.Column:
    return F.struct(*[F.col(prefix + f).alias(f) for f in PARAM_FIELDS])


def _literal_grid(canonical_only: bool = True) -> F.Column:
    rows = [r for r in STRATEGIES if (r[0] == r[1] or not canonical_only)]
    structs = []
    for r in rows:
        vals = dict(zip(PARAM_FIELDS, r[2:]))
        structs.append(F.struct(F.lit(r[0]).alias("strategy"), *[
            F.lit(vals[f.name]).cast(f.dataType).alias(f.name) for f in PARAMS_TYPE.fields]))
    return F.array(*structs)


def prompt_grid(prompts: DataFrame, keep=("rec_id",)) -> DataFrame:
    """Every prompt x every canonical strategy. A fixed 22-way fan-out per row, written as a
    generator over a literal array: no join and no shuffle."""
    return prompts.select(*keep, F.inline(_literal_grid()))


def resolve_strategy(requests: DataFrame, catalog: DataFrame, name_col: str = "requested") -> DataFrame:
    """A requested name (alias accepted) -> canonical row. Unknown names drop out here;
    ``unknown_strategy`` reports them."""
    cat = F.broadcast(catalog.withColumnRenamed("name", name_col))
    return requests.join(cat, name_col, "inner")


def unknown_strategy(requests: DataFrame, catalog: DataFrame, name_col: str = "requested") -> DataFrame:
    cat = F.broadcast(catalog.select(F.col("name").alias(name_col)))
    return requests.join(cat, name_col, "left_anti")


def uniform7(key) -> F.Column:
    """Repeatable uniform integer in [0, 16^7) from md5 of a key."""
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint")


def assign_strategy(df: DataFrame, key_col: str, seed: str = "taffeta") -> DataFrame:
    """A repeatable 'random choice' among the canonical strategies."""
    names = F.array(*[F.lit(n) for n in CANONICAL])
    idx = F.pmod(uniform7(F.concat(F.lit(seed), F.col(key_col).cast("string"))), F.lit(len(CANONICAL)))
    return df.withColumn("strategy", F.element_at(names, (idx + 1).cast("int")))


def override_params(df: DataFrame, base: str = "params", kwargs: str = "kwargs") -> DataFrame:
    """Dict merge where the right side wins: a non-null kwarg replaces the strategy value."""
    return df.withColumn("merged", F.struct(*[
        F.coalesce(F.col(f"{kwargs}.{f}"), F.col(f"{base}.{f}")).alias(f) for f in PARAM_FIELDS]))
