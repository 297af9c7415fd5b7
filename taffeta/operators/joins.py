"""Joins of many rows with a table of weighted keys, a few of which may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer keys than this can each hold more than one part in so many of all weight.
HEAVY = 1000


#: Rows of a table that is broadcast whole: a word and two numbers each, some tens of MB.
SMALL = 1_000_000


def is_small(table: DataFrame) -> bool:
    return table.count() <= SMALL


def heavy_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str = "count", how: str = "inner",
               heavy: int = HEAVY, small: bool | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key) on ``keys``; ``how`` is inner or left.

    Keys with more than 1/``heavy`` of the table's total weight are fewer than ``heavy``, whatever the data:
    they are broadcast, and their rows never shuffled. The others are joined by a shuffle in which no key
    has more than that share. Rows without a key, and keys without a weight, go the second way. A table of
    at most ``SMALL`` rows is broadcast whole (``small`` says so where it is known).
    """
    if is_small(table) if small is None else small:
        return rows.join(F.broadcast(table), keys, how)
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.coalesce(F.col(weight), F.lit(0)) * F.lit(heavy) > F.lit(total)
    few, many = F.broadcast(table.where(is_heavy)), table.where(~is_heavy)
    light = rows.join(F.broadcast(table.where(is_heavy).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(light.join(many, keys, how))
