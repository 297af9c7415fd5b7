"""A set of hashes folded into a table of bits of fixed size, which is all that is broadcast.

A hash that was put in is always found; another one may be found too. Whoever asks must therefore
need it for speed only. The size doesn't grow with the data: as more hashes go in, more others pass.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

#: Bits of a table: 4 MB.
BITS = 1 << 25
_BLOCK = 15


@pandas_udf(BinaryType())
def _packed(slots):
    import pandas as pd
    out = []
    for of_block in slots:
        bits = np.zeros(1 << _BLOCK, np.uint8)
        bits[np.asarray(of_block, np.int64) & ((1 << _BLOCK) - 1)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return pd.Series(out)


def build(hashes: DataFrame, col: str, bits: int = BITS) -> Broadcast:
    """The broadcast table of a column of 64-bit hashes. The driver gets at most ``bits`` bits."""
    spark = hashes.sparkSession
    slots = hashes.select(F.col(col).bitwiseAND(F.lit(bits - 1)).cast("int").alias("slot")).distinct()
    blocks = slots.groupBy(F.shiftright("slot", _BLOCK).alias("block")).agg(F.collect_list("slot").alias("slots"))
    table = np.zeros(max(bits >> 3, 1 << (_BLOCK - 3)), np.uint8)
    for block, packed in blocks.select("block", _packed("slots")).collect():
        at = block << (_BLOCK - 3)
        table[at : at + len(packed)] = np.frombuffer(packed, np.uint8)
    return spark.sparkContext.broadcast((bits, table.tobytes()))


def passes(sieve: Broadcast, hashes: np.ndarray) -> np.ndarray:
    bits, raw = sieve.value
    slot = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return (np.frombuffer(raw, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
