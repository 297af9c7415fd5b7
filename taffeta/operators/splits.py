"""Train/test splits.

W5 reproduces the reference's exact sizes: test = ceil(share * n) rows, chosen as the rows with
the smallest md5(seed || key). A global row_number would need one ordered partition; instead the
md5 threshold is found by radix selection: each pass counts rows per 12-bit digit of the hash
inside the current prefix (an aggregate of at most 4096 rows), keeps the digit where the k-th row
falls, and descends to the last digit. The passes read the stored hashes alone, and one comparison then
labels every row. Rows whose hashes tie at the threshold, copies, are stored and told apart by their
place, found the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taffeta.session import materialise

DIGIT_BITS = 12


def hash_key(cols, seed: str) -> F.Column:
    return F.md5(F.concat_ws("\u0001", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def kth_smallest(df: DataFrame, col: F.Column, k: int, bits: int = 60) -> tuple[int, int] | None:
    """The k-th smallest (1-based) value of a non-negative bigint below 2**bits, and which of its
    equals the k-th row is. Every digit is one aggregate of at most 4096 rows."""
    if k <= 0:
        return None
    shift, prefix, remaining, cond = bits, 0, k, F.lit(True)
    while shift > 0:
        shift -= DIGIT_BITS
        digit = F.shiftright(col, shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        for d, n in sorted(df.where(cond).groupBy(digit.alias("d")).count().collect()):
            if remaining <= n:
                break
            remaining -= n
        prefix = (prefix << DIGIT_BITS) | d
        cond = F.shiftright(col, shift) == F.lit(prefix)
    return prefix, remaining


def train_test_split(df: DataFrame, key_cols, test_size: float = 0.2, seed: str = "taffeta",
                     mode: str = "exact") -> DataFrame:
    """Add ``split`` in {train, test}. ``exact``: ceil(test_size * n) test rows, like the
    reference's splitter, repeated keys told apart by their place; ``hash``: one pass, each row
    independently (approximate sizes)."""
    d = df.withColumn("_h", hash_key(key_cols, seed))
    if mode == "hash":
        u = F.conv(F.substring("_h", 1, 7), 16, 10).cast("bigint") / float(16 ** 7)
        return d.withColumn("split", F.when(u < test_size, "test").otherwise("train")).drop("_h")
    # only the hashes are stored; rows are made again for the labels, whatever they carry
    h = F.conv(F.substring("_h", 1, 15), 16, 10).cast("bigint")
    hashes = materialise(d.select(h.alias("_h")), "split-hashes")
    found = kth_smallest(hashes, F.col("_h"), math.ceil(test_size * hashes.count()))
    if found is None:
        return d.withColumn("split", F.lit("train")).drop("_h")
    value, nth = found
    if nth == hashes.where(F.col("_h") == value).count():
        return d.withColumn("split", F.when(h <= value, "test").otherwise("train")).drop("_h")
    # of the rows with the last hash some are test: these few are told apart by their place
    tied = materialise(d.where(h == value).withColumn("_row", F.monotonically_increasing_id()), "split-ties")
    last, _ = kth_smallest(tied, F.col("_row"), nth)
    tied = tied.withColumn("split", F.when(F.col("_row") <= last, "test").otherwise("train")).drop("_row")
    others = d.where(h != value).withColumn("split", F.when(h < value, "test").otherwise("train"))
    return others.unionByName(tied).drop("_h")


def split_by_key(df: DataFrame, key_cols, test_size: float = 0.2, seed: str = "taffeta") -> DataFrame:
    """Group-safe split: rows sharing the key (all prefixes of one record) share a side."""
    u = F.conv(F.substring(hash_key(key_cols, seed), 1, 7), 16, 10).cast("bigint") / float(16 ** 7)
    return df.withColumn("split", F.when(u < test_size, "test").otherwise("train"))
