"""Document fingerprints: a bottom-k sketch of each text's shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's word shingles. The sketch of
a union of texts is the ``k`` smallest of their sketches' hashes, so parts merge in any order. From
two sketches follow resemblance (Jaccard), containment and the number of distinct shingles; while a
text has at most ``k`` shingles its sketch is the whole set and the answers are exact.

Defined cases: a null text counts as empty. A text without words has the empty sketch. Two empty
sketches resemble each other by 1, an empty and another by 0; an empty set is contained in any set.
Equal texts have equal fingerprints. Rows are kept as they come, repeated ones too.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from taffeta.llm.hashing import BLOCK_BYTES, Words, blocks

SHINGLE = 5
K = 128
_SPACE = float(1 << 64)
_FIRST = -(1 << 63)


def sketches(texts: list[str | None], shingle: int = SHINGLE, k: int = K) -> list[np.ndarray]:
    out = []
    for a, b in blocks(texts):
        out += [s[:k] for s in Words(texts[a:b]).shingles(shingle)]
    return out


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def unpack(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), ">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity, estimated on the ``k`` smallest hashes of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twin = both[1:] == both[:-1]
    distinct = len(both) - int(twin.sum())
    if distinct <= k:
        return (len(both) - distinct) / distinct
    rank = np.cumsum(np.concatenate([[True], ~twin]))
    return int((twin & (rank[1:] <= k)).sum()) / k


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _SPACE / float(sketch[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the first set that the second holds."""
    if not len(a):
        return 1.0
    both = np.unique(np.concatenate([a, b]))[:k]
    shared = resemblance(a, b, k) * distinct_count(both, k)
    return min(1.0, shared / distinct_count(a, k))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """Adds (or replaces) the packed sketch of each whole text; no shuffle."""

    @pandas_udf("string")
    def of(s):
        import pandas as pd
        texts = [t if isinstance(t, str) else None for t in s]
        return pd.Series([pack(x) for x in sketches(texts, shingle, k)])

    return df.withColumn(out, of(F.col(text)))


def merge(df: DataFrame, by: list[str], col: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each group: the ``k`` smallest distinct hashes of its members'. Ranks
    are cut per task before the shuffle, first per (group, salt), so a group of any size is spread."""

    @pandas_udf("array<binary>")
    def hashes(s):
        import pandas as pd
        raw = [base64.b64decode(x or "") for x in s]
        return pd.Series([[x[i : i + 8] for i in range(0, len(x), 8)] for x in raw])

    rows = df.select(*by, F.explode(hashes(F.col(col))).alias("_hash")).distinct()
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_hash"), F.lit(64)))
    for keys in ([*by, "_salt"], by):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.hex("_hash"))).alias("_h"))
    merged = packed.select(*by, F.base64(F.unhex(F.array_join("_h", ""))).alias(col))
    return df.select(*by).distinct().join(merged, [*by], "left").withColumn(col, F.coalesce(col, F.lit("")))


def compare(df: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """Adds resemblance, containment of a in b and both distinct shingle counts."""

    @pandas_udf("resemblance double, contained double, distinct_a double, distinct_b double")
    def of(x, y):
        import pandas as pd
        rows = []
        for p, q in zip(map(unpack, x), map(unpack, y)):
            rows.append((resemblance(p, q, k), containment(p, q, k), distinct_count(p, k), distinct_count(q, k)))
        return pd.DataFrame(rows, columns=["resemblance", "contained", "distinct_a", "distinct_b"])

    return df.withColumn("_c", of(F.col(a), F.col(b))).select(*df.columns, "_c.*")


EDIT_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
               "edited_fingerprint string, near_edited double, near_next double")


def edit(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by as many first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edited_rows(ids: list, texts: list[str], shingle: int, k: int) -> tuple[list, ...]:
    """Result columns of all texts but the last, which is only the last but one's successor."""
    edited = [edit(t, u) for t, u in zip(texts, texts[1:])]
    own, other = sketches(texts, shingle, k), sketches(edited, shingle, k)
    n = len(edited)
    return (ids[:n], [len(t) for t in texts[:n]],
            [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            [pack(s) for s in own[:n]], [pack(s) for s in other],
            [resemblance(a, b, k) for a, b in zip(own, other)],
            [resemblance(a, b, k) for a, b in zip(own, own[1:])])


def with_edited(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its text edited with the next document's (ascending
    doc_id, null first, ties by text; after the last comes the first).

    Ids are cut into ranges at sampled quantiles. Each range is sorted in its own task, closed by a
    copy of the next range's first row, so each row meets its successor without a global sort or
    window. One shuffle of the texts.
    """
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("doc_id", F.lit(_FIRST)).alias("_key"))
    cuts = docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) or []
    bounds = np.unique(np.array([int(c) for c in cuts], np.int64))

    @pandas_udf("int")
    def range_of(key):
        import pandas as pd
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), side="right").astype(np.int32))

    rows = docs.withColumn("_range", range_of("_key"))
    # one number for each range, which the count of partitions bounds
    heads = sorted(docs.select(range_of("_key").alias("r"), "_key").groupBy("r").agg(F.min("_key")).collect())
    if not heads:
        return spark.createDataFrame([], EDIT_SCHEMA)
    targets = [(key, heads[i - 1][0]) for i, (_, key) in enumerate(heads)]
    closing = spark.createDataFrame(targets, "_key long, _range int")
    closing = docs.join(F.broadcast(closing), "_key").select("doc_id", "text", "_key", "_range", F.lit(1).alias("_close"))
    rows = rows.select("doc_id", "text", "_key", "_range", F.lit(0).alias("_close")).union(closing)
    rows = rows.repartition(max(n // 8, 1), "_range").sortWithinPartitions("_range", "_close", "_key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                            ("near_edited", pa.float64()), ("near_next", pa.float64())])
        ids, texts, size, closed = [], [], 0, True

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(_edited_rows(ids, texts, shingle, k), schema)], schema=schema)

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (0, 1, 4))
            for doc_id, text, close in zip(*columns):
                if close and closed:
                    continue  # further copies of a range's first key
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                closed = bool(close)
                if closed or (size > BLOCK_BYTES and len(texts) > 1):
                    yield flush()
                    ids, texts = ([], []) if closed else (ids[-1:], texts[-1:])
                    size = sum(map(len, texts))

    return rows.mapInArrow(run, EDIT_SCHEMA)
