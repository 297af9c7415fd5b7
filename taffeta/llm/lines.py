"""Line de-duplication by shared word windows.

A passage of ``min_words`` words or more that an earlier document holds is deleted from the later
one, wherever it stands in either, however often and in whatever lines. The first document keeps
every passage. A window is ``min_words`` consecutive words; each points at the first document (by
doc_id) that has it, and the words of a window whose first document is another one go. That is
linear in the words however many documents share a window, and leaves no common run of
``min_words`` words.

Only windows that can be shared are compared. The mark of a window is the least hash of the runs of
half as many words inside it, so that equal windows have equal marks and neighbours mostly the same
one. Marks of one document only are dropped first. The others' windows are compared by runs: windows
of one mark that follow each other, by the hash of all their words. A run that an earlier document has
goes whole. What is left are the first documents of each run; where those of one mark have different
runs, their windows are compared one by one, by their mark and their own hash, 128 bits together. That
is enough, as the first document of a window is also the first of the run in which it has it.

Defined cases: null and empty texts stay as they are. Documents are ordered by doc_id (null last),
then in the order of reading; a later copy of a whole text is left with an empty text. What comes
twice in one document only stays. Letters A-Z match in either case; line breaks are white space.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taffeta.llm.batches import lean
from taffeta.llm.hashing import Words, _power_tables, blocks, mix
from taffeta.llm.numbering import numbered_buckets
from taffeta.operators.ranking import global_rank
from taffeta.session import SCRATCH, drop_shuffles, materialise, remove_scratch, scratch_path

MIN_WORDS = 50
_LAST = (1 << 63) - 1


class Windows:
    """Windows of ``size`` words of texts: ``owner`` (index of the text), ``at`` (first word, from the
    text's first), ``marks``, and by ``hashes`` a hash of all their words."""

    def __init__(self, texts: list[str | None], size: int):
        w, self.size = Words(texts), size
        h, n = w.hashes, len(w.starts)
        self._up_to = np.zeros(n + 1, np.uint64)
        np.cumsum(h * _power_tables(n)[0][:n], out=self._up_to[1:])
        owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
        self._inside = np.flatnonzero(owner[: max(n - size + 1, 0)] == owner[size - 1 :])
        self.owner = owner[self._inside]
        self.at = self._inside - w.first[self.owner]
        half = (size + 1) // 2
        least, reach, every = self._spans(half), 1, size - half + 1
        while reach < every and len(least):
            step = min(reach, every - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        self.marks = least[self._inside].view(np.int64)

    def _spans(self, size: int) -> np.ndarray:
        n = max(len(self._up_to) - size, 0)
        return mix((self._up_to[size:] - self._up_to[:n]) * _power_tables(n)[1][:n])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first window of each run of windows of one text and mark, their number, and a hash of all the run's words."""
        new = np.ones(len(self.at), bool)
        new[1:] = (np.diff(self.marks) != 0) | (np.diff(self.owner) != 0)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(self.at)))
        begin = self._inside[first]
        words = self._up_to[begin + n + (self.size - 1)] - self._up_to[begin]
        return first, n, mix(words * _power_tables(len(self._up_to))[1][begin]).view(np.int64)

    def hashes(self) -> np.ndarray:
        return self._spans(self.size)[self._inside].view(np.int64)


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience: positions of the lines that are unique in both, the longest run rising in both.
    ``dedup_lines`` doesn't use it, as it finds passages in any order."""
    def unique(x):
        seen: dict[int, int] = {}
        for i, h in enumerate(x):
            seen[h] = -1 if h in seen else i
        return {h: i for h, i in seen.items() if i >= 0}

    where = unique(b)
    pairs = sorted((i, where[h]) for h, i in unique(a).items() if h in where)
    tops: list[int] = []
    back: list[int] = []
    ends: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        back.append(ends[at - 1] if at else -1)
        tops[at:at + 1], ends[at:at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def cut(text: str, ranges: list[tuple[int, int]], words: Words, index: int) -> str:
    """The text without the given word ranges and the white space that follows each."""
    data, first, base = words.data, int(words.first[index]), int(words.at[index])
    stop = int(words.at[index + 1]) - 1
    keep, at = [], base
    for i, j in ranges:
        begin = int(words.starts[first + i])
        end = int(words.starts[first + j]) if first + j < int(words.first[index + 1]) else stop
        if begin > at:
            keep.append(data[at:begin].tobytes())
        at = max(at, end)
    keep.append(data[at:stop].tobytes())
    return b"".join(keep).decode("utf-8", "surrogatepass")


def _ranges(starts: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Word ranges that so many windows from these words on cover, in order."""
    order = np.argsort(starts)
    starts, stops = starts[order], np.maximum.accumulate(starts[order] + counts[order] + (size - 1))
    gaps = np.flatnonzero(starts[1:] > stops[:-1])
    first, last = starts[np.concatenate([[0], gaps + 1])], stops[np.concatenate([gaps, [len(stops) - 1]])]
    return list(zip(first.tolist(), last.tolist()))


def _run_rows(rows: DataFrame, size: int) -> DataFrame:
    """(rid, mark, run, at, n): each run of ``n`` windows of one mark, from word ``at`` on, with a hash of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                found = Windows(texts[a:b], size)
                first, n, hashes = found.runs()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rids[a + found.owner[first]]), pa.array(found.marks[first]), pa.array(hashes),
                     pa.array(found.at[first], pa.int32()), pa.array(n, pa.int32())], names=["rid", "mark", "run", "at", "n"])

    return rows.select("rid", "text").mapInArrow(lean(run), "rid long, mark long, run long, at int, n int")


def _window_rows(rows: DataFrame, size: int) -> DataFrame:
    """(place, mark, hash, at) of the windows whose mark is one of the row's ``marks``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, texts, wanted = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
            for a, b in blocks(texts):
                found = Windows(texts[a:b], size)
                stops = np.searchsorted(found.owner, np.arange(b - a + 1))
                at = np.concatenate([i + np.flatnonzero(np.isin(found.marks[i:j], wanted[a + k].values.to_numpy()))
                                     for k, (i, j) in enumerate(zip(stops[:-1], stops[1:]))])
                yield pa.RecordBatch.from_arrays([pa.array(places[a + found.owner[at]]), pa.array(found.marks[at]), pa.array(found.hashes()[at]), pa.array(found.at[at], pa.int32())],
                                                 names=["place", "mark", "hash", "at"])

    return rows.select("place", "text", "marks").mapInArrow(lean(run), "place long, mark long, hash long, at int")


def _of_several(rows: DataFrame, document: str) -> DataFrame:
    """Marks that rows of different documents have."""
    ends = rows.groupBy("mark").agg(F.min(document).alias("least"), F.max(document).alias("most"))
    return ends.where("least < most").select("mark")


def dedup_lines(spark: SparkSession, docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``; later repeats of common passages are deleted from the text."""
    columns = docs.columns
    # joins hash the side that has each key once: the other, of runs, windows or texts, need not be sorted
    rows_in = numbered_buckets(docs)
    rows = rows_in.select(F.col("_rid").alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("key"), F.col(text).alias("text"))
    path = scratch_path(spark, "lines-runs")
    _run_rows(rows, min_words).write.options(**SCRATCH).parquet(path)
    runs = spark.read.parquet(path)
    shared = materialise(_of_several(runs, "rid"), "lines-shared")
    drop_shuffles(spark)
    # a document's place in the order of doc_id: one number to compare runs and windows by
    places = global_rank(rows.select("rid", "key"), ["key", "rid"], "place").select("rid", "place")
    alike = materialise(runs.join(shared.hint("shuffle_hash"), "mark").join(places, "rid"), "lines-alike")
    remove_scratch(spark, path)
    drop_shuffles(spark)
    firsts = materialise(alike.groupBy("mark", "run").agg(F.min("place").alias("source")), "lines-heads")
    alike = materialise(alike.join(firsts.hint("shuffle_hash"), ["mark", "run"]), "lines-known")
    copies = (alike.where("place != source").groupBy("rid")
              .agg(F.collect_list(F.struct("at", "n")).alias("runs")))
    # stored, so that Spark can split a mark of many runs in the join
    several = materialise(_of_several(firsts, "source"), "lines-several")
    wanted = alike.where("place = source").join(several.hint("shuffle_hash"), "mark")
    wanted = materialise(wanted.groupBy("rid", "place").agg(F.collect_list("mark").alias("marks")), "lines-wanted")
    drop_shuffles(spark)
    path = scratch_path(spark, "lines-windows")
    _window_rows(rows.join(wanted.hint("shuffle_hash"), "rid"), min_words).write.options(**SCRATCH).parquet(path)
    drop_shuffles(spark)
    windows = spark.read.parquet(path)
    heads = (windows.groupBy("mark", "hash").agg(F.min("place").alias("source"), F.count("*").alias("n"))
             .where("n > 1").select("mark", "hash", "source"))
    heads = materialise(heads, "lines-heads")
    drop_shuffles(spark)
    found = []
    for half in ("hash < 0", "hash >= 0"):  # the files of one half's shuffle go before the other's come
        later = windows.where(half).join(heads.where(half).hint("shuffle_hash"), ["mark", "hash"]).where(F.col("place") != F.col("source"))
        found.append(materialise(later.groupBy("place").agg(F.collect_list("at").alias("starts")), "lines-found"))
        drop_shuffles(spark)
    remove_scratch(spark, path)
    one = F.transform("starts", lambda at: F.struct(at.alias("at"), F.lit(1).alias("n")))
    found = found[0].union(found[1]).join(wanted.select("rid", "place"), "place").select("rid", one.alias("runs"))
    found = found.union(copies).groupBy(F.col("rid").alias("_rid")).agg(F.flatten(F.collect_list("runs")).alias("_runs"))
    out = rows_in.join(found.hint("shuffle_hash"), "_rid", "left").select(*columns, "_runs")
    at, n = columns.index(text), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.column(n).is_valid()
            texts, runs = batch.column(at).filter(hit).to_pylist(), batch.column(n).filter(hit)
            for a, b in blocks(texts):
                words = Words(texts[a:b])
                for i in range(a, b):
                    starts, counts = runs[i].values.flatten()
                    texts[i] = cut(texts[i], _ranges(starts.to_numpy(), counts.to_numpy(), min_words), words, i - a)
            made = list(batch.columns[:n])
            made[at] = pc.replace_with_mask(made[at], hit, pa.array(texts, made[at].type))
            yield pa.RecordBatch.from_arrays(made, names=columns)

    return out.mapInArrow(lean(run), docs.schema)
