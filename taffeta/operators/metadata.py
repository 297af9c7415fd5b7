"""Metadata extraction and record templating."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taffeta.functions import taf


def extract_temps(df: DataFrame, text_col: str = "text") -> DataFrame:
    """M1: first ``TX..`` and, greedily, the last ``TN..`` on the same line, null if absent."""
    return df.withColumns({"tx": taf.extract(text_col, taf.METADATA_TEMPS, 1),
                           "tn": taf.extract(text_col, taf.METADATA_TEMPS, 2)})


def extract_custom(df: DataFrame, pattern: str, text_col: str = "text",
                   extractor=None) -> DataFrame:
    """A configurable pattern; named groups become columns. ``extractor`` may replace
    the pattern by any Column -> struct function (the reference's metadata callback)."""
    if extractor is not None:
        return df.withColumn("_m", extractor(F.col(text_col))).select("*", "_m.*").drop("_m")
    return df.withColumns(taf.extract_named(text_col, pattern))


def build_header(df: DataFrame, cols=("tx", "tn"), on_missing: str = "drop") -> DataFrame:
    """M3: header = metadata columns joined by a space.

    The reference raises on a record without metadata; ``on_missing`` chooses between
    ``drop`` (default), ``fail`` (raise on the first such record) and ``keep_null``.
    """
    present = F.lit(True)
    for c in cols:
        present = present & F.col(c).isNotNull()
    header = F.when(present, F.concat_ws(" ", *[F.col(c) for c in cols]))
    if on_missing == "drop":
        return df.where(present).withColumn("header", header)
    if on_missing == "fail":
        return df.withColumn("header", F.when(present, header).otherwise(
            F.raise_error(F.lit("record without metadata"))))
    if on_missing == "keep_null":
        return df.withColumn("header", header)
    raise ValueError(on_missing)


def apply_template(df: DataFrame, text_col: str = "text", header_col: str = "header",
                   template: str = taf.TEMPLATE) -> DataFrame:
    """M4+M5: delete every template head (``'TAF '``) from the body, then fill the template."""
    head = template.split("[")[0]
    before, rest = template.split("{header}")
    middle, after = rest.split("{text}")
    body = F.replace(F.col(text_col), F.lit(head), F.lit(""))
    return df.withColumn("templated", F.concat(F.lit(before), F.col(header_col), F.lit(middle),
                                               body, F.lit(after)))


def template_records(df: DataFrame, text_col: str = "text", on_missing: str = "drop") -> DataFrame:
    """M1 -> M3 -> M5 in one projection (no join: derived columns stay on their row)."""
    return apply_template(build_header(extract_temps(df, text_col), on_missing=on_missing), text_col)


def extract_station(df: DataFrame, text_col: str = "prompt", mode: str = "as_is") -> DataFrame:
    """M6: station id. ``as_is`` is the notebook's greedy rule (last 4-letter word followed by
    whitespace); ``first`` takes the word before the issue time."""
    pattern = taf.STATION_AS_IS if mode == "as_is" else taf.STATION_FIRST
    return df.withColumn("icao", taf.extract(text_col, pattern, 1))


def extract_temps_strict(df: DataFrame, text_col: str = "text") -> DataFrame:
    """M8: end-anchored TX/TN with their times, and the plain group test."""
    named = taf.extract_named(text_col, taf.TEMPERATURE_END)
    return df.withColumns({**named,
                           "has_temperature_group": F.col(text_col).rlike(taf.TEMPERATURE_GROUP)})


def filter_corrections(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop corrected forecasts (a ``COR`` word anywhere)."""
    return df.where(~F.col(text_col).rlike(taf.CORRECTION))


def cap_per_station(df: DataFrame, stations, cap: int = 100, key_col: str = "rec_id",
                    station_col: str = "icao", seed: str = "taffeta", salts: int = 16) -> DataFrame:
    """Keep listed stations and at most ``cap`` records each, chosen by md5 of the key.

    A hot station would put all its rows into one window partition; instead we take the top
    ``cap`` per (station, salt) first, then the top ``cap`` of those <= cap*salts survivors.
    """
    order = F.md5(F.concat(F.lit(seed), F.col(key_col).cast("string")))
    d = df.where(F.col(station_col).isin(list(stations))).withColumn("_o", order)
    d = d.withColumn("_salt", F.pmod(F.xxhash64(F.col(key_col)), F.lit(salts)))
    w1 = Window.partitionBy(station_col, "_salt").orderBy("_o", key_col)
    d = d.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= cap)
    w2 = Window.partitionBy(station_col).orderBy("_o", key_col)
    return (d.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= cap)
             .drop("_o", "_salt", "_r"))
