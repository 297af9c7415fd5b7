"""Raw corpus -> records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taffeta.functions.generators import posexplode_rows

from taffeta.functions.taf import RECORD_SPLIT
from taffeta.functions.text import py_strip


def segment_records(df: DataFrame, text_col: str = "value", pattern: str = RECORD_SPLIT,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Split each text on the record delimiter; one row per piece with its position, stripped.

    Like Python's ``re.split`` a trailing delimiter leaves an empty last piece; callers that
    template records drop it together with other records lacking metadata.
    """
    pieces = posexplode_rows(df, keep, F.split(F.col(text_col), pattern, -1), "pos", "raw")
    return pieces.select(*keep, "pos", py_strip("raw").alias("text"))
