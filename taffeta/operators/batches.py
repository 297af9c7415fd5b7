"""A user function mapped over Arrow batches (the reference's batched ``Dataset.map``)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                batch_size: int | None = None) -> DataFrame:
    """Apply ``fn`` to batches of ``batch_size`` rows of each partition, the last one of a partition being
    what is left; without a size, to the Arrow batches as they come
    (``spark.sql.execution.arrow.maxRecordsPerBatch``). No row crosses the Python boundary on its own."""
    def run(batches):
        held: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            if not batch_size:
                yield fn(b)
                continue
            held, size = [*held, b], size + len(b)
            if size < batch_size:
                continue
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else b
            whole = size - size % batch_size
            for i in range(0, whole, batch_size):
                yield fn(rows.iloc[i : i + batch_size].reset_index(drop=True))
            held, size = ([rows.iloc[whole:]], size - whole) if size > whole else ([], 0)
        if size:
            yield fn(pd.concat(held, ignore_index=True))
    return df.mapInPandas(run, schema)


def word_counts(b: pd.DataFrame) -> pd.DataFrame:
    """Example batch function: word counts of prompt and completion. A text's words are counted and let go at once;
    pandas' ``str.split`` would hold the lists of a whole batch."""
    def words(c: str) -> pd.Series:
        return pd.Series([len(x.split()) for x in b[c].tolist()], dtype="int64", index=b.index)

    return pd.DataFrame({"prompt": b["prompt"], "completion": b["completion"],
                         "prompt_words": words("prompt"), "completion_words": words("completion")})
