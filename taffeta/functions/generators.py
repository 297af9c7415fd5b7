"""Row generators that keep expensive array expressions from being evaluated twice.

For a plain ``explode``/``posexplode``/``inline`` Catalyst infers a filter ``size(array) > 0``
and pushes it towards the scan, re-evaluating the array expression (a regex split of a whole
text, say) below any repartition, i.e. before the work is spread over cores. The ``_outer``
generators get no inferred filter; dropping the one row an empty array yields, by its null
position, gives exactly the plain generator's output (null elements included).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posexplode_rows(df: DataFrame, keep, array: Column, pos: str = "pos", value: str = "value") -> DataFrame:
    return (df.select(*keep, F.posexplode_outer(array).alias(pos, value))
              .where(F.col(pos).isNotNull()))


def explode_rows(df: DataFrame, keep, array: Column, value: str = "value") -> DataFrame:
    return posexplode_rows(df, keep, array, "_gen_pos", value).drop("_gen_pos")


def inline_rows(df: DataFrame, keep, array: Column) -> DataFrame:
    d = posexplode_rows(df, keep, array, "_gen_pos", "_gen_s")
    return d.select(*keep, "_gen_s.*")
