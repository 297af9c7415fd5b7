"""Substring de-duplication by compaction of a De Bruijn graph of words.

The graph's edges are the ``WINDOW``-word windows of the texts. Each word that stands in a window which
starts earlier too (smaller doc_id, then the row, then the place) is removed; windows are judged on the
input, not on what is left.

1. Equal texts are settled by a digest: the first holder stays in play, of the others all that any
   window covers goes.
2. Each window has an anchor, the ``ANCHOR``-word part of it with the smallest hash. Equal windows have
   equal anchors, so anchors that come once in the corpus rule out all their windows. Anchors are
   counted; the repeated ones are folded into a table of bits of fixed size (``sieve``).
3. The windows around repeated anchors are shuffled by anchor, those of one anchor in a text as one row of
   hashes, less those that a task has met before. Anchors of ``HOT`` places or more are spread: there
   each window goes by its own hash. Rows are sorted by source coordinate, so the first holder of each
   window comes first, and each run of windows that have one holder at one distance, a path that does
   not branch between the two places, is compacted into one row.
4. Spark joins these rows end to end by document, which gives the long repeated spans.
5. The source coordinates verify them: each distinct span of a holder is hashed again, by two other hash
   functions, where it stands in the holder's text, and words go only if the later text gives the same.

Texts are stored once in buckets of their row's number and never shuffled again. A task sees a block of
texts, one anchor's windows or one document's spans. Nothing is capped; the bits only save work.

Defined cases: a null or empty text has no words; one with fewer words than a window loses none; a null
doc_id counts as the largest; of rows with one doc_id one is taken as the earlier; an empty table
gives no rows. Only the id and the text are read: extra columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taffeta.llm import sieve, vocab
from taffeta.llm.hashing import Words, mix
from taffeta.llm.numbering import numbered_buckets
from taffeta.session import materialise

WINDOW = 20
ANCHOR = 10
#: Places of an anchor from which its windows are spread.
HOT = 5000
BLOCK_BYTES = 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = (1 << 63) - 1

SEGMENT = "_rid long, start int, n int, of_rid long, of_start int"


def _grams(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (which may cross texts)."""
    out = np.zeros(max(len(hashed) - size + 1, 0), np.uint64)
    for j in range(size):
        out *= _STEP
        out += hashed[j : j + len(out)]
    return mix(out)


class Windows:
    """The windows of some texts: ``at`` the first word of each, ``hashes``, ``anchors`` the word at
    which the anchor of each begins and ``keys`` the anchors' hashes."""

    def __init__(self, texts: list[str | None], window: int, anchor: int):
        words = Words(texts)
        codes, distinct = vocab.coded(words, lower=False)
        hashed = vocab.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        self.doc, self.first = vocab.doc_of(words), words.first
        last = words.first[1:][self.doc] if len(codes) else self.doc
        self.at = np.flatnonzero(np.arange(len(codes)) + window <= last)
        self.hashes = _grams(hashed, window)[self.at]
        parts = _grams(hashed, anchor)
        self.anchors, self.keys = self.at.copy(), parts[self.at]
        for j in range(1, window - anchor + 1):
            other = parts[self.at + j]
            less = other < self.keys
            self.keys[less] = other[less]
            self.anchors[less] = self.at[less] + j


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    """Blocks of texts in the order of their coordinates: [(doc, _rid)] and texts."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc", "_rid", "text"))):
            rows.append(row)
            size += len(row[2]) if row[2] else 0
            if size > BLOCK_BYTES:
                rows.sort(key=lambda r: r[:2])
                yield np.array([r[:2] for r in rows], np.int64), [r[2] for r in rows]
                rows, size = [], 0
    if rows:
        rows.sort(key=lambda r: r[:2])
        yield np.array([r[:2] for r in rows], np.int64), [r[2] for r in rows]


def _paths(group: np.ndarray, start: np.ndarray, of_rid: np.ndarray, of_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run begins that goes on word by word in one group and in one source, and its length."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(group) != 0) | (np.diff(start) != 1) | (np.diff(of_rid) != 0) | (np.diff(of_start) != 1)
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, len(start)))


def repeated_anchors(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(hash, n) of the anchors that come twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            w = Windows(block, window, anchor)
            _, one = np.unique(w.anchors, return_index=True)
            keys, n = np.unique(w.keys[one], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["hash", "n"])

    counts = texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return counts.where("n > 1")


EDGES = f"key long, doc long, {SEGMENT}, hashes binary"


def _edges(texts: DataFrame, repeated, hot, window: int, anchor: int) -> DataFrame:
    """Rows of window hashes by anchor (``hashes``), and the segments that a task could tell alone."""
    names = [f.split()[0] for f in EDGES.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in EDGES.split(", ")]

    def rows(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(count, t) for c, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches):
            w = Windows(block, window, anchor)
            use = np.flatnonzero(sieve.passes(repeated, w.keys))
            at, hashes, anchors = w.at[use], w.hashes[use], w.anchors[use]
            spread = sieve.passes(hot, w.keys[use])
            keys = np.where(spread, hashes, w.keys[use]).view(np.int64)
            doc = w.doc[at]
            start, rid = at - w.first[doc], ids[doc, 1]
            _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
            of = first[same]
            again = np.flatnonzero(of != np.arange(len(of)))
            begins, n = _paths(doc[again], start[again], rid[of[again]], start[of[again]])
            begins = again[begins]
            if len(begins):
                yield rows(len(begins), key=pa.array(mix(rid[begins].astype(np.uint64)).view(np.int64)), doc=pa.array(ids[doc[begins], 0]),
                           _rid=pa.array(rid[begins]), start=pa.array(start[begins]), n=pa.array(n),
                           of_rid=pa.array(rid[of[begins]]), of_start=pa.array(start[of[begins]]))
            new = np.flatnonzero(of == np.arange(len(of)))
            if len(new):
                cut = np.ones(len(new), bool)
                cut[1:] = (np.diff(at[new]) != 1) | (np.diff(anchors[new]) != 0) | spread[new][1:] | spread[new][:-1]
                begins = np.flatnonzero(cut)
                offsets = (np.append(begins, len(new)) * 8).astype(np.int32)
                cells = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(hashes[new])])
                begins = new[begins]
                yield rows(len(begins), key=pa.array(keys[begins]), doc=pa.array(ids[doc[begins], 0]), _rid=pa.array(rid[begins]),
                           start=pa.array(start[begins]), hashes=cells)

    return texts.mapInArrow(run, EDGES)


def _segments(edges: DataFrame) -> DataFrame:
    """Each run of windows with its first holder. Rows of one anchor follow each other in order of their
    coordinates; of the anchor that a batch ends with, the distinct windows are carried on."""
    names = [f.split()[0] for f in SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, seen, seen_rid, seen_start = None, *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))
        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column("n")))
            if known.num_rows:
                yield known.select(names)
            batch = batch.filter(pc.is_valid(batch.column("hashes")))
            if not batch.num_rows:
                continue
            key, rid, start = (batch.column(c).to_numpy() for c in ("key", "_rid", "start"))
            cells = batch.column("hashes").to_pylist()
            sizes = np.array([len(c) for c in cells]) >> 3
            row = np.repeat(np.arange(len(cells)), sizes)
            begin = np.cumsum(sizes) - sizes
            start = start[row].astype(np.int64) + np.arange(len(row)) - begin[row]
            if key[0] != open_key:
                seen, seen_rid, seen_start = seen[:0], seen_rid[:0], seen_start[:0]
            old = len(seen)
            hashes = np.concatenate([seen, np.frombuffer(b"".join(cells), np.uint64)])
            rids, starts = np.concatenate([seen_rid, rid[row]]), np.concatenate([seen_start, start])
            _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
            of = first[same]
            again = np.flatnonzero(of != np.arange(len(of)))
            begins, n = _paths(row[again - old], starts[again], rids[of[again]], starts[of[again]])
            begins = again[begins]
            if len(begins):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (
                    (rids[begins], pa.int64()), (starts[begins], pa.int32()), (n, pa.int32()),
                    (rids[of[begins]], pa.int64()), (starts[of[begins]], pa.int32()))], names=names)
            stay = of == np.arange(len(of))
            stay[old:] &= key[row] == key[-1]
            if key[-1] != open_key:
                stay[:old] = False
            open_key, seen, seen_rid, seen_start = key[-1], hashes[stay], rids[stay], starts[stay]

    rows = edges.repartition("key").sortWithinPartitions("key", "doc", "_rid", "start")
    return rows.mapInArrow(run, SEGMENT)


SPANS = "_rid long, spans array<struct<start: int, n: int, of_rid: long, of_start: int>>"


def _joined(segments: DataFrame, window: int) -> DataFrame:
    """Segments of a document that go on in one source are joined; ``n`` counts words then. A document's
    windows bound a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            start, n, of_rid, of_start = (flat.field(i).to_numpy().astype(np.int64) for i in range(4))
            order = np.lexsort((start, row))
            row, start, n, of_rid, of_start = (x[order] for x in (row, start, n, of_rid, of_start))
            new = np.ones(len(row), bool)
            new[1:] = ((np.diff(row) != 0) | (start[1:] != start[:-1] + n[:-1]) | (np.diff(of_rid) != 0)
                       | (of_start[1:] != of_start[:-1] + n[:-1]))
            begins = np.flatnonzero(new)
            n = np.add.reduceat(n, begins) + window - 1
            fields = [pa.array(start[begins], pa.int32()), pa.array(n, pa.int32()), pa.array(of_rid[begins]), pa.array(of_start[begins], pa.int32())]
            spans = pa.StructArray.from_arrays(fields, names=["start", "n", "of_rid", "of_start"])
            offsets = np.searchsorted(row[begins], np.arange(len(sizes) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), pa.ListArray.from_arrays(pa.array(offsets), spans)], names=["_rid", "spans"])

    rows = segments.groupBy("_rid").agg(F.collect_list(F.struct("start", "n", "of_rid", "of_start")).alias("spans"))
    return rows.mapInArrow(run, SPANS)


def _digests(text: str | None, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of spans of a text's words, by other functions than those of the windows."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    out = []
    for seed, base in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        hashed = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
        powers = np.full(len(words) + 1, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * powers[:-1], dtype=np.uint64)])
        # spans are brought to one power, that of the text's end, which an odd base allows
        down = np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
        down[0] = 1
        np.multiply.accumulate(down, out=down)
        out.append(mix((sums[start + n] - sums[start]) * down[start]))
    return out[0].view(np.int64), out[1].view(np.int64)


DIGESTS = "of_rid long, of_start int, n int, one long, two long"


def _source_digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The digests of each distinct span at its source. Spans of a source are asked for in groups of
    neighbouring places, so that one of many spans is several rows."""
    asked = spans.select(F.explode("spans").alias("s")).select("s.of_rid", "s.of_start", "s.n").distinct()
    place = F.shiftright("of_start", 12)
    asked = asked.groupBy(F.col("of_rid").alias("_rid"), place.alias("place")).agg(F.collect_list(F.struct("of_start", "n")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, spans_of in zip(*(batch.column(c).to_pylist() for c in ("_rid", "text", "asked"))):
                start, n = (np.array([s[c] for s in spans_of], np.int64) for c in ("of_start", "n"))
                one, two = _digests(text, start, n)
                yield pa.RecordBatch.from_arrays([pa.array([rid] * len(start), pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()),
                                                  pa.array(one), pa.array(two)], names=["of_rid", "of_start", "n", "one", "two"])

    return docs.join(asked.hint("shuffle_hash"), "_rid").select("_rid", "text", "asked").mapInArrow(run, DIGESTS)


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(docs: DataFrame, window: int, text_out: bool) -> DataFrame:
    schema = RESULT if text_out else RESULT.replace("kept ", "kept_sha256 ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, copy, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy", "spans"))):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                total = len(words)
                if copy and total >= window:
                    words = []
                elif spans:
                    start, n, one, two = (np.array([s[c] for s in spans], np.int64) for c in ("start", "n", "one", "two"))
                    mine = _digests(text, start, n)
                    good = (mine[0] == one) & (mine[1] == two)
                    edges = np.zeros(total + 1, np.int64)
                    np.add.at(edges, start[good], 1)
                    np.add.at(edges, (start + n)[good], -1)
                    keep = np.cumsum(edges[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                joined = b" ".join(words)
                out.append((doc_id, total, total - len(words), joined.decode("utf-8", "surrogatepass") if text_out else hashlib.sha256(joined).hexdigest()))
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.string(),))], names=names) \
                if out else pa.RecordBatch.from_pydict({c: [] for c in names})

    return docs.select("doc_id", "text", "copy", "spans").mapInArrow(run, schema)


def dedup_spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the words that stay, joined by one space: ``kept``, or, without
    ``texts``, their digest ``kept_sha256``. One row for each of the input."""
    docs = numbered_buckets(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    coordinate = F.coalesce("doc_id", F.lit(_LAST))
    digests = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.struct(coordinate.alias("doc"), "_rid").alias("at"))
    firsts = materialise(digests.groupBy("digest").agg(F.min("at").alias("at")).select("at._rid"), "first-texts")
    distinct = docs.join(firsts.hint("shuffle_hash"), "_rid", "left_semi").select(coordinate.alias("doc"), "_rid", "text")

    anchors = materialise(repeated_anchors(distinct, window, anchor), "anchors")
    repeated, hot = sieve.build(anchors, "hash"), sieve.build(anchors.where(F.col("n") >= HOT), "hash")
    segments = _segments(_edges(distinct, repeated, hot, window, anchor))
    spans = materialise(_joined(segments, window), "spans")

    each = spans.select("_rid", F.explode("spans").alias("s")).select("_rid", "s.*")
    verified = each.join(_source_digests(docs, spans), ["of_rid", "of_start", "n"])
    verified = verified.groupBy("_rid").agg(F.collect_list(F.struct("start", "n", "one", "two")).alias("spans"))
    known = firsts.withColumn("copy", F.lit(False)).join(verified, "_rid", "left")
    rows = docs.join(known.hint("shuffle_hash"), "_rid", "left").withColumn("copy", F.coalesce("copy", F.lit(True)))
    return _cut(rows, window, texts)
