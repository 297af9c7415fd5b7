"""Ranked lexical search: Block-Max MaxScore over shards of an inverted index.

``build_index`` reads each whole text once. A task cuts its documents into shards of about
``SHARD_BYTES`` of text and writes, for each shard and term, the posting list in blocks of ``BLOCK``
documents: gaps and counts as variable-length integers, and beside them, readable without
decompression, each block's last document, largest count and shortest document.

``search`` takes the queries in blocks of bounded size and reads only the lists of their terms. In a
shard, the lists of a query are sorted by their bound. Those whose bounds together stay below the
tenth best score so far are not essential: a document must be in some other list to matter. The
essential lists give the candidates; in the others, from the highest bound down, a candidate goes
when its score, the maximum of the one block it can be in and the bounds of the lists still to come
stay below that score, and only blocks that some candidate needs are decompressed. A task's shards
hand on their heaps, and Spark merges those of the tasks.

Bounds are compared with less-than, so equal scores are never lost: results equal an exhaustive
scoring. Work on a shard is bounded by its size; nothing depends on how often a term comes.

Defined cases: a null or empty text has no terms and takes no part; a query without terms, or whose
terms no document has, gets no rows; each of several rows with one id is a document or a query of its
own; a null doc_id comes last among equal scores; an empty table gives no rows. Extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taffeta.llm import vocab
from taffeta.llm.hashing import Words
from taffeta.session import materialise

SHARD_BYTES = 16 << 20
BLOCK = 128
#: Characters of query texts that are ranked, and broadcast, at once.
QUERY_CHARS = 1 << 20

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = np.zeros(256, bool)
_TERM_BYTES[48:58] = _TERM_BYTES[65:91] = _TERM_BYTES[97:123] = _TERM_BYTES[128:] = True
_A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

INDEX_SCHEMA = ("shard long, term string, n_docs long, n_terms long, last binary, most binary, shortest binary, "
                "at binary, postings binary, lengths binary, doc_ids binary, no_id binary")


def terms_of(text: str | None) -> list[str]:
    return re.findall(TERM, text.translate(_A_TO_Z)) if text else []


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers as bytes, seven bits in each, the lowest first; and where each begins."""
    size = np.ones(len(values), np.int64)
    for shift in range(7, 63, 7):
        more = values >= (1 << shift)
        if not more.any():
            break
        size += more
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.empty(at[-1], np.uint8)
    for j in range(int(size.max(initial=0))):
        sel = np.flatnonzero(size > j)
        out[at[sel] + j] = ((values[sel] >> (7 * j)) & 127) | ((size[sel] > j + 1) << 7)
    return out, at


def unpack(raw: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(raw < 128) + 1
    begin = np.concatenate([[0], end[:-1]])
    size, out = end - begin, np.zeros(len(end), np.int64)
    for j in range(int(size.max(initial=0))):
        sel = np.flatnonzero(size > j)
        out[sel] |= (raw[begin[sel] + j].astype(np.int64) & 127) << (7 * j)
    return out


def _cells(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary cells of an array's items from each cut to the next."""
    offsets = (cuts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _shard_rows(shard: int, ids: list, texts: list) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
    words = Words(texts, _TERM_BYTES)
    codes, terms = vocab.coded(words)
    lengths = np.diff(words.first)
    norms = {"shard": [shard], "n_docs": [int((lengths > 0).sum())], "n_terms": [len(codes)], "lengths": [lengths.astype(np.int64).tobytes()],
             "doc_ids": [np.array([i or 0 for i in ids], np.int64).tobytes()], "no_id": [np.array([i is None for i in ids]).tobytes()]}
    types = {"shard": pa.int64(), "term": pa.string(), "n_docs": pa.int64(), "n_terms": pa.int64()}

    def batch(columns: dict, n: int) -> pa.RecordBatch:
        typed = [(c, types.get(c, pa.binary())) for c in names]
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in typed], names=names)

    yield batch(norms, 1)
    if not len(codes):
        return
    n = len(texts)
    cells, counts = np.unique(codes * n + vocab.doc_of(words), return_counts=True)
    term, doc = np.divmod(cells, n)
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    begins = np.flatnonzero((np.arange(len(term)) - first[term]) % BLOCK == 0)
    gaps = np.diff(doc, prepend=0)
    gaps[begins] = doc[begins]
    raw, at = pack(np.stack([gaps, counts], 1).ravel())
    block = np.searchsorted(begins, first)  # each term's first block
    ends = np.append(begins[1:], len(term))
    starts = at[2 * begins]
    yield batch({
        "shard": np.full(len(terms), shard), "term": terms.cast(pa.string()), "n_docs": np.diff(first),
        "n_terms": np.add.reduceat(counts, first[:-1]),
        "last": _cells(doc[ends - 1].astype(np.int32), block),
        "most": _cells(np.maximum.reduceat(counts, begins).astype(np.int64), block),
        "shortest": _cells(np.minimum.reduceat(lengths[doc], begins).astype(np.int64), block),
        "at": _cells((starts - starts[block[term[begins]]]).astype(np.int32), block),
        "postings": _cells(raw, at[2 * first]),
    }, len(terms))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: a row for each shard and term, and one for each shard (``term`` null) with its
    documents' ids and lengths. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t) if t else 0
                if size > SHARD_BYTES:
                    yield from _shard_rows(shard, ids, texts)
                    shard, ids, texts, size = shard + 1, [], [], 0
        if ids:
            yield from _shard_rows(shard, ids, texts)

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, INDEX_SCHEMA)
    return materialise(rows, "lexical-index")


class Shard:
    """The lists of one shard that some query reads; what is decompressed is kept while it is ranked."""

    def __init__(self, norms: dict, all_docs: int, all_terms: int):
        n = np.frombuffer(norms["lengths"], np.int64)
        self.ids = np.frombuffer(norms["doc_ids"], np.int64)
        self.no_id = np.frombuffer(norms["no_id"], bool)
        self.all_docs, self.all_terms = all_docs, all_terms
        self.norm = self._norm(n)
        self.lists: dict[str, dict] = {}
        self.opened: dict = {}

    def _norm(self, n: np.ndarray) -> np.ndarray:
        return 100 - 75 + (75 * n * self.all_docs) // self.all_terms

    @staticmethod
    def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)

    def add(self, row: dict) -> None:
        most, shortest = (np.frombuffer(row[c], np.int64) for c in ("most", "shortest"))
        bounds = self.impact(most, self._norm(shortest))
        self.lists[row["term"]] = {"last": np.frombuffer(row["last"], np.int32), "bounds": bounds, "bound": int(bounds.max()),
                                   "at": np.frombuffer(row["at"], np.int32), "raw": np.frombuffer(row["postings"], np.uint8)}

    def block(self, term: str, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (term, b) not in self.opened:
            of = self.lists[term]
            end = of["at"][b + 1] if b + 1 < len(of["at"]) else len(of["raw"])
            pairs = unpack(of["raw"][of["at"][b] : end])
            docs = np.cumsum(pairs[::2])
            self.opened[term, b] = docs, self.impact(pairs[1::2], self.norm[docs])
        return self.opened[term, b]

    def whole(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        if (term, -1) not in self.opened:
            of = self.lists[term]
            pairs, docs = unpack(of["raw"]), np.zeros(0, np.int64)
            gaps = pairs[::2].copy()
            heads = np.arange(BLOCK, len(gaps), BLOCK)  # a block's first gap is the document itself
            gaps[heads] -= of["last"][: len(heads)]
            docs = np.cumsum(gaps)
            self.opened[term, -1] = docs, self.impact(pairs[1::2], self.norm[docs])
        return self.opened[term, -1]

    def rank(self, query: list[tuple[str, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may score ``least`` or more, with their scores."""
        lists = sorted((weight * self.lists[t]["bound"], t, weight) for t, weight in query if weight and t in self.lists)
        sums = np.cumsum([b for b, _, _ in lists]).tolist()
        split = sum(s < least for s in sums)
        if split == len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores = np.zeros(len(self.ids), np.int64)
        for _, term, weight in lists[split:]:
            docs, impacts = self.whole(term)
            scores[docs] += weight * impacts
        found = np.flatnonzero(scores)
        score = scores[found]
        for i in range(split - 1, -1, -1):
            _, term, weight = lists[i]
            of, rest = self.lists[term], sums[i - 1] if i else 0
            b = np.searchsorted(of["last"], found)
            inside = b < len(of["last"])
            top = np.where(inside, weight * of["bounds"][np.minimum(b, len(of["bounds"]) - 1)], 0)
            alive = score + top + rest >= least
            found, score, b = found[alive], score[alive], np.where(inside, b, -1)[alive]
            for k in np.unique(b[b >= 0]).tolist():
                docs, impacts = self.block(term, k)
                mine = np.flatnonzero(b == k)
                at = np.minimum(np.searchsorted(docs, found[mine]), len(docs) - 1)
                score[mine] += np.where(docs[at] == found[mine], weight * impacts[at], 0)
        keep = score >= max(least, 1)
        return found[keep], score[keep]


def _weights(queries: list[list[str]], df: dict[str, int], all_docs: int) -> list[list[tuple[str, int]]]:
    weight = {t: math.floor(1000 * math.log((2 * all_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    return [[(t, times * weight[t]) for t, times in sorted(Counter(q).items()) if t in weight] for q in queries]


def _ranked(index: DataFrame, queries: list[list[str]], all_docs: int, all_terms: int, k: int) -> DataFrame:
    """(query number, doc_id, score): each task's ``k`` best for each query of a block."""
    spark = index.sparkSession
    terms = spark.createDataFrame([(t,) for t in sorted({t for q in queries for t in q})], "term string")
    lists = index.join(F.broadcast(terms), "term", "left_semi").select(*index.columns)
    df = {r["term"]: r["n"] for r in lists.groupBy("term").agg(F.sum("n_docs").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_weights(queries, df, all_docs))
    read = ("shard", "term", "last", "most", "shortest", "at", "postings", "lengths", "doc_ids", "no_id")
    rows = lists.unionByName(index.where("term is null")).select(*read)
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in weighted]

        def rank(shard: Shard) -> None:
            for q, query in enumerate(weighted):
                score, no_id, ids = best[q]
                least = int(score[-1]) if len(score) == k else 1
                found, scores = shard.rank(query, least)
                if len(found):
                    score, no_id, ids = (np.concatenate(x) for x in ((score, scores), (no_id, shard.no_id[found]), (ids, shard.ids[found])))
                    top = np.lexsort((ids, no_id, -score))[:k]
                    best[q] = score[top], no_id[top], ids[top]

        shard = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["term"] is None:
                    if shard:
                        rank(shard)
                    shard = Shard(row, all_docs, all_terms)
                else:
                    shard.add(row)
        if shard:
            rank(shard)
        number = np.repeat(np.arange(len(best)), [len(s) for s, _, _ in best])
        if len(number):
            score, no_id, ids = (np.concatenate([b[i] for b in best]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(ids, mask=no_id), pa.array(score)],
                                             names=["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query long, doc_id long, score long")


RESULT_SCHEMA = "item_id long, rank int, doc_id long, score long"


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank (from 1), doc_id, score."""
    index = build_index(docs)
    all_docs, all_terms = index.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0]
    out = spark.createDataFrame([], RESULT_SCHEMA)
    if not all_terms or not chars:
        return out
    blocks = math.ceil(chars / QUERY_CHARS)
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        queries = [terms_of(r["text"]) for r in rows]
        if not any(queries):
            continue
        numbers = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(rows)], "query long, item_id long")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = _ranked(index, queries, all_docs, all_terms, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(numbers), "query").select("item_id", "rank", "doc_id", "score")
        out = ranked if blocks == 1 else out.unionAll(materialise(ranked, "ranked"))
    return out
