"""Result analysis (M6 X2-X5 A2-A6 W1-W4): temperatures, deltas, summaries, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taffeta.functions import taf
from taffeta.operators.quantiles import quantiles
from taffeta.session import materialise

TEMP_VARS = ("prompt_TX", "prompt_TN", "completion_TX", "completion_TN")
DELTA_VARS = ("delta_TX", "delta_TN", "delta")
ALL_VARS = TEMP_VARS + DELTA_VARS


def temperature(c) -> F.Column:
    """X2+X3: ``M05`` -> -5.0; missing stays null (try_cast: ANSI would raise on '')."""
    return F.replace(c, F.lit("M"), F.lit("-")).try_cast("double")


def extract_temperatures(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Named TX/TN groups -> ``{prefix}_TX`` / ``{prefix}_TN`` doubles."""
    named = taf.extract_named(col, taf.TEMPERATURE_NAMED)
    return df.withColumns({f"{prefix}_{k}": temperature(v) for k, v in named.items()})


def temperature_deltas(results: DataFrame) -> DataFrame:
    """M6 + X4 + X5: the notebook's analysis frame."""
    d = results.withColumn("icao", taf.extract("prompt", taf.STATION_AS_IS, 1))
    d = extract_temperatures(d, "prompt", "prompt")
    d = extract_temperatures(d, "completion", "completion")
    d = d.withColumns({"delta_TX": F.abs(F.col("prompt_TX") - F.col("completion_TX")),
                       "delta_TN": F.abs(F.col("prompt_TN") - F.col("completion_TN"))})
    return d.withColumn("delta", F.col("delta_TX") + F.col("delta_TN"))


def describe(df: DataFrame, cols=ALL_VARS) -> DataFrame:
    """A2: count, mean, sample std, min, 25/50/75 % (linear interpolation), max per column.

    The columns are stored once; the summary is one aggregate of them melted (an Expand, no
    shuffle), the quantiles are exact order statistics (``quantiles``), which keep no value -> count map
    and so hold for continuous values too.
    """
    d = materialise(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "described")
    v = F.col("value")
    stats = d.unpivot([], list(cols), "variable", "value").groupBy("variable").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    counts = d.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    found = quantiles(d, counts, [0.25, 0.5, 0.75])
    at = d.sparkSession.createDataFrame([(c, *map(float_or_none, q)) for c, q in found.items()], "variable string, p25 double, p50 double, p75 double")
    return stats.join(F.broadcast(at), "variable").select("variable", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def float_or_none(x) -> float | None:
    return None if x is None else float(x)


def std_by(df: DataFrame, keys=("strategy",), value: str = "delta") -> DataFrame:
    """A3: sample standard deviation per group (null for a single row; null keys dropped)."""
    d = df
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    return d.groupBy(*keys).agg(F.stddev_samp(value).alias(f"std_{value}"))


def pivot_mean(df: DataFrame, index: str = "icao", columns: str = "strategy",
               value: str = "delta", values: list[str] | None = None) -> DataFrame:
    """A4: mean per (index, column value) spread into columns, null values dropped. ``values``
    names the columns; without it Spark collects the distinct ones (``spark.sql.pivotMaxValues``)."""
    d = df.where(F.col(index).isNotNull() & F.col(columns).isNotNull() & F.col(value).isNotNull())
    return d.groupBy(index).pivot(columns, values).agg(F.avg(value))


def normalise_by_max(df: DataFrame, value: str = "delta", below: float = 20.0,
                     out: str = "normalized") -> DataFrame:
    """W1 (+P5 P6): null out values >= ``below``, drop nulls, divide by the global max.
    The max is one small job (partial max per partition, a single number back) used as a
    literal, so the plans built on the result carry no subquery and identical branches reuse
    their exchanges instead of recomputing the input."""
    d = df.where(F.col(value) < below)
    mx = d.agg(F.max(value)).first()[0]
    return d.withColumn(out, F.col(value) / F.lit(mx).cast("double"))


def normalise_pivot(df: DataFrame, index: str = "icao", columns: str = "strategy",
                    value: str = "delta") -> DataFrame:
    """W2 in long form: mean per (index, column), divided by that column's max over the index.
    The window runs over the aggregated (index x column) table, never over row data."""
    d = df.where(F.col(index).isNotNull() & F.col(value).isNotNull())
    m = d.groupBy(index, columns).agg(F.avg(value).alias(f"mean_{value}"))
    w = Window.partitionBy(columns)
    return m.withColumn("normalized", F.col(f"mean_{value}") / F.max(f"mean_{value}").over(w))


def histogram(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """Numpy-style equal-width histogram per group with density.

    Range = the group's [min, max], widened by +-0.5 when min == max; the last bin is closed
    on the right. Every bin is emitted, empty ones with count 0. The rows are first reduced to
    (group, value, count), a partial-aggregated group-by whose size is the number of distinct
    values, so the group ranges, bin assignment and bin counts all run on that small table.
    """
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    vc = d.groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    stats = vc.groupBy(group).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"),
                                  F.sum("_c").alias("n"))
    lo = F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn"))
    hi = F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx"))
    stats = stats.select(group, "n", lo.alias("lo"), hi.alias("hi"))
    b = F.floor((F.col(value) - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo")))
    counts = (vc.join(stats, group)
                .select(group, F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"), "_c")
                .groupBy(group, "bin").agg(F.sum("_c").alias("count")))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    every = stats.select(group, "n", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counts, [group, "bin"], "left").fillna(0, ["count"])
    return out.select(group, "bin",
                      (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.col("count").cast("bigint").alias("count"),
                      (F.col("count") / (F.col("n") * width)).alias("density"))


def sample_rows(df: DataFrame, n: int, key_cols, seed: str = "taffeta") -> DataFrame:
    """N rows without replacement, repeatable: the n smallest md5(seed || key).
    A top-k (TakeOrderedAndProject): each partition keeps n rows, the driver merges them."""
    key = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in key_cols])
    return df.withColumn("_h", F.md5(key)).orderBy("_h", *key_cols).limit(n).drop("_h")
