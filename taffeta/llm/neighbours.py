"""Approximate nearest neighbours on shifted Hilbert curves.

Each of several orderings projects the vectors by its own random rotation, shifts the grid and sorts
by the Hilbert key. Spark range-partitions the keys of all orderings at once; the position of a vector
is its partition's offset plus its place there. A query is compared with the vectors whose position
lies within a window of its own in any ordering; the windows' best are merged and ranked by the
exact distance on the original vectors.

Equal vectors are one entry of the index, with the k + 1 smallest of their ids: no more of them can be
among the k nearest of any row. Copies are therefore found exactly, however many there are, and don't fill
the windows of others. Queries with equal vectors are searched once.

``WINDOW`` is a share of the distinct vectors: the share that gives the wanted recall depends on how clustered
the vectors are and not on their number. Vectors that are nearly uniform in all their dimensions
(as the test tables are: the tenth neighbour is at 1.1, a random row at 1.4) need wide windows.

Only the scale of the projections is fitted, on at most about ``SAMPLE`` vectors. Every valid vector is indexed.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; 0.0 and -0.0 are equal. Equal distances go by the smaller vec_id (null
last). A row is not its own neighbour, but another row of the same vec_id is. With fewer candidates
than ``k`` all are returned; an empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from taffeta.llm import hilbert
from taffeta.session import materialise

ORDERINGS, WINDOW, LEAST_WINDOW = 12, 0.06, 128
DIMS, BITS = 12, 4
SAMPLE = 10_000
#: Rows of an ordering that one task compares with the queries that reach them.
CHUNK = 2048


def valid(vectors: DataFrame, vector: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, as doubles."""
    v = F.col("vec")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


class Orderings:
    """Rotations, scales and shifts of the orderings."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.each = []
        n = sample.shape[1]
        for _ in range(ORDERINGS):
            turn = np.linalg.qr(rng.normal(size=(n, n)))[0][:, : min(DIMS, n)]
            y = sample @ turn
            self.each.append((turn, y.mean(0), np.maximum(y.std(0), 1e-12), rng.random(turn.shape[1])))

    def keys(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        for turn, mean, std, shift in self.each:
            z = np.clip(1.7 * (vectors @ turn - mean) / std, -50, 50)
            cells = ((1 / (1 + np.exp(-z)) + shift) / 2 * (1 << BITS)).astype(np.int64)
            yield hilbert.keys(np.clip(cells, 0, (1 << BITS) - 1), BITS).view(np.int64)


def nearest(q: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and distances of the ``k`` nearest rows, ties to the smaller id."""
    d = np.sqrt(np.square(rows - q).sum(axis=1))
    at = np.arange(len(d)) if len(d) <= k else np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    at = at[np.lexsort((ids[at], d[at]))][:k]
    return at, d[at]


def _matrix(packed) -> np.ndarray:
    packed = list(packed)
    return np.frombuffer(b"".join(packed)).reshape(len(packed), -1)


def _distinct(rows: DataFrame, is_query, k: int) -> tuple[DataFrame, DataFrame]:
    """Stored: the distinct vectors (node, vec, ids, asks) with the ``k + 1`` smallest ids of each, null last,
    and whether a query has them; and the queries (query_id, node)."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last()))
    # each task sends at most k + 1 rows of a vector: the limit is applied before the shuffle, too
    least = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    least = least.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id")))["vec_id"].alias("ids"))
    nodes = materialise(least.withColumn("node", F.monotonically_increasing_id()), "neighbour-vectors")
    queries = materialise(rows.where(is_query).join(nodes.select("node", "vec"), "vec").select(F.col("vec_id").alias("query_id"), "node"), "neighbour-queries")
    asks = queries.select("node").distinct().withColumn("asks", F.lit(True))
    return nodes.join(asks, "node", "left").select("node", "vec", "ids", F.coalesce("asks", F.lit(False)).alias("asks")), queries


def _index(nodes: DataFrame, orderings: Orderings) -> DataFrame:
    """Stored rows (t, key, node, least, asks, vec, part, place), range-partitioned and sorted."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                vectors = _matrix(np.array(v).tobytes() for v in part.column(3).to_pylist())
                packed = pa.array([v.tobytes() for v in vectors], pa.binary())
                for t, key in enumerate(orderings.keys(vectors)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), *part.columns[:3], packed],
                                                     names=["t", "key", "node", "least", "asks", "vec"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(range(seen, seen + n), pa.int64())],
                                             names=[*batch.schema.names, "part", "place"])
            seen += n

    schema = "t int, key long, node long, least long, asks boolean, vec binary"
    keyed = nodes.select("node", F.get("ids", F.lit(0)).alias("least"), "asks", "vec")
    keyed = materialise(keyed.mapInArrow(spread, schema), "hilbert-keys")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = ["t", "key", F.xxhash64("node"), "node"]
    return materialise(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(place, f"{schema}, part int, place long"), "hilbert-index")


def _near(spark: SparkSession, nodes: DataFrame, total: int, k: int) -> DataFrame:
    """(asked, node, score): the ``k`` nearest other vectors found for each vector that a query has."""
    share = F.pmod(F.xxhash64("vec"), F.lit(1_000_003)) < min(1.0, SAMPLE / total) * 1_000_003
    sample = np.array([r[0] for r in nodes.where(share).select("vec").collect()] or [nodes.select("vec").first()[0]])
    index = _index(nodes, Orderings(sample))

    # one row for each partition and ordering: where it begins
    begins, at = [], {}
    for t, part, n, low in index.groupBy("t", "part").agg(F.count("*"), F.min("place")).orderBy("t", "part").collect():
        begins.append((t, part, at.get(t, 0) - low))
        at[t] = at.get(t, 0) + n
    begins = F.broadcast(spark.createDataFrame(begins, "t int, part int, begin long"))
    placed = index.join(begins, ["t", "part"]).withColumn("at", F.col("begin") + F.col("place"))
    reach = max(LEAST_WINDOW, int(WINDOW * total))
    candidates = placed.select("t", F.floor(F.col("at") / CHUNK).alias("chunk"), "at", "node", "least", "vec")
    last = (total - 1) // CHUNK
    span = F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - reach) / CHUNK)), F.least(F.lit(last), F.floor((F.col("at") + reach) / CHUNK)))
    asked = placed.where("asks").withColumn("_chunk", F.explode(span))
    asked = asked.select(*[F.col(c).alias(c.strip("_")) for c in ("t", "_chunk", "at", "node", "vec")])

    def compare(left, right):
        import pandas as pd
        out = []
        if len(left) and len(right):
            c, least = _matrix(right["vec"]), right["least"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
            places, nodes_, shown = right["at"].to_numpy(), right["node"].to_numpy(), right["least"].to_numpy()
            for q, at, node in zip(_matrix(left["vec"]), left["at"], left["node"]):
                near = np.flatnonzero((np.abs(places - at) <= reach) & (nodes_ != node))
                best, d = nearest(q, c[near], least[near], k)
                out += [(node, nodes_[near[i]], shown[near[i]], s) for i, s in zip(best, d)]
        frame = pd.DataFrame(out, columns=["asked", "node", "least", "score"])
        return frame.astype({"asked": "int64", "node": "int64", "score": "float64"})

    found = (asked.groupBy("t", "chunk").cogroup(candidates.groupBy("t", "chunk"))
             .applyInPandas(compare, "asked long, node long, least long, score double"))
    found = found.groupBy("asked", "node").agg(F.first("least").alias("least"), F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("score", F.col("least").asc_nulls_last(), "node"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("asked", "node", "score")


def search(spark: SparkSession, vectors: DataFrame, is_query, vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for each query row
    (``is_query``: a condition on vec_id)."""
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid(vectors, vector)
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    nodes, queries = _distinct(rows.where(F.size("vec") == sizes[0][0]), is_query, k)
    near = _near(spark, nodes, nodes.count(), k)
    own = nodes.where("asks").select(F.col("node").alias("asked"), "node", F.lit(0.0).alias("score"))
    ids = near.union(own).join(nodes.select("node", "ids"), "node")
    ids = ids.select("asked", "score", (F.col("asked") == F.col("node")).alias("own"), F.explode("ids").alias("vec_id"))
    # the k + 1 best rows, the query's own among them; which copy of an id is the own one doesn't matter
    nth = F.row_number().over(Window.partitionBy("asked").orderBy("score", F.col("vec_id").asc_nulls_last(), "own"))
    best = ids.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    best = best.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("nth", "score", "own", "vec_id"))).alias("best"))
    rows_ = queries.join(best, queries["node"] == best["asked"]).select("query_id", "best")
    self_ = F.filter("best", lambda b: b["own"] & (b["vec_id"] == F.col("query_id")))["nth"]
    others = F.slice(F.filter("best", lambda b: ~b["nth"].eqNullSafe(F.get(self_, F.lit(0)))), 1, k)
    return rows_.select("query_id", F.posexplode(others).alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
