"""JSON sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taffeta.session import drop_shuffles, materialise, open_writers, same_splits

PAIR_SCHEMA = T.StructType([T.StructField("prompt", T.StringType()),
                            T.StructField("completion", T.StringType())])
RESULT_SCHEMA = T.StructType([T.StructField("prompt", T.StringType()),
                              T.StructField("completion", T.StringType()),
                              T.StructField("strategy", T.StringType())])


def write_jsonl(df: DataFrame, path: str, partition_by=None, mode: str = "error", compression: str | None = None) -> None:
    """JSON Lines; ``partition_by`` moves those columns into the folder names. Readers tell the
    ``compression`` by the files' names."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if compression:
        w = w.option("compression", compression)
    with open_writers(df.sparkSession):
        w.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One scan over a file, folder or glob; a declared schema skips inference."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_json_arrays(df: DataFrame, path: str, documents: int | None = None, compression: str | None = None) -> None:
    """Write the rows as JSON arrays, the reference's ``json.dump`` of a list: ``documents`` of them (as many
    as shuffle partitions if not given), each in its own folder ``document=<n>``. Rows are dealt out by
    their content, in one shuffle, whose files go at once; a document without rows is not written. A window over a
    document tells its first and last row, which hold the brackets: built-in expressions only. Readers tell the
    ``compression`` by the files' names."""
    n = documents or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(_to_json_col(df).alias("json"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("document", F.pmod(F.xxhash64("json"), F.lit(n)))
    place = Window.partitionBy("document").orderBy("_at")
    begins, ends = F.row_number().over(place) == 1, F.lead("_at").over(place).isNull()
    value = F.concat(F.when(begins, "[").otherwise(","), "json", F.when(ends, "\n]").otherwise(""))
    w = rows.select(value.alias("value"), "document").write.partitionBy("document")
    if compression:
        w = w.option("compression", compression)
    w.text(path)
    drop_shuffles(df.sparkSession)


#: Files of these names are read from their beginning, by one task each.
UNSPLIT = r"\.(gz|deflate|snappy|lz4|zst)$"


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents holding arrays of records, one document split over many tasks (a compressed one is read
    by one task).

    The reader cuts the files into byte ranges and at each closing brace. Whether a piece begins inside a
    string follows from the number of quotes before it, and how deep it is nested from the braces outside
    strings; a record ends at a brace that brings the depth back to zero. A task counts along its split, in the
    order in which it reads, so pieces are neither stored nor shuffled. Where a file has several splits, one pass
    over them tells how many quotes and braces lie before each, and what a split holds of a record
    that begins or ends in another one is put together afterwards. Records are parsed by
    ``from_json``. Only a record has to fit in a row; what is outside records is not looked at. A path may be
    a folder of folders.
    """
    reader = spark.read.option("lineSep", "}").option("recursiveFileLookup", True)
    pieces = reader.text(path).select(F.col("_metadata.file_path").alias("path"),
                                      F.col("_metadata.file_block_start").alias("split"), "value")
    unsplit = {bool(re.search(UNSPLIT, f)) for f in pieces.inputFiles()}
    parts = []
    if True in unsplit:
        begin = F.when(F.col("split") == 0, F.lit(0))
        found = pieces.where(F.col("path").rlike(UNSPLIT)).withColumns({"inside": begin, "depth": begin.cast("bigint")})
        parts.append(found.mapInArrow(_records, _RECORDS).where(F.col("path").isNull()).select("text"))
    if unsplit != {True}:
        found = _split_records(pieces.where(~F.col("path").rlike(UNSPLIT)))
        parts += [found.where(F.col("path").isNull()).select("text"), _joined(found.where(F.col("path").isNotNull()))]
    whole = reduce(DataFrame.unionAll, parts)
    body = F.expr("substring(text, instr(text, '{'), length(text))")
    return whole.select(F.from_json(body, schema).alias("r")).select("r.*")


_TOTALS = "path string, split bigint, quotes bigint, even bigint, odd bigint"
_RECORDS = "text string, path string, split bigint, part int, ended boolean"


def _split_records(pieces: DataFrame) -> DataFrame:
    """The records of files that may have several splits, stored: those within a split without a path, and what
    is left at a split's beginning (``part`` 0) and end (1) with it."""
    with same_splits(pieces.sparkSession):
        totals = pieces.mapInArrow(_totals, _TOTALS)
        before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        at = totals.withColumn("inside", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
        at = at.withColumn("_change", F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd")))
        at = at.withColumn("depth", F.coalesce(F.sum("_change").over(before), F.lit(0)))
        found = pieces.join(F.broadcast(at.select("path", "split", "inside", "depth")), ["path", "split"], "left")
        return materialise(found.select(*pieces.columns, "inside", "depth").mapInArrow(_records, _RECORDS), "json-records")


def _joined(left: DataFrame) -> DataFrame:
    """The records that lie across splits: at most two rows for each split."""
    before = Window.partitionBy("path").orderBy("split", "part").rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("record", F.coalesce(F.sum(F.col("ended").cast("int")).over(before), F.lit(0)))
    p = F.array_sort(F.collect_list(F.struct("split", "part", "text")))
    whole = left.groupBy("path", "record").agg(p.alias("p"), F.max("ended").alias("ended")).where("ended")
    return whole.select(F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def _scanned(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces as one text, each with the brace at its end, and the places in it of the pieces' ends, of quotes
    and of opening braces, without escaped ones."""
    text = pc.binary_join_element_wise(values.cast(pa.string()), "}", "")
    at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4)
    data = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]]
    quotes, opens, slashes = (np.flatnonzero(data == ord(c)) for c in '"{\\')
    if len(slashes):  # what follows an odd run of backslashes; valid JSON never escapes a closing brace
        first = np.diff(slashes, prepend=-2) != 1
        run = np.arange(len(slashes)) - np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))
        escaped = slashes[run % 2 == 0] + 1
        quotes, opens = (x[~np.isin(x, escaped)] for x in (quotes, opens))
    return data, (at[1:] - at[0]).astype(np.int64), quotes, opens


def _depths(ends: np.ndarray, quotes: np.ndarray, opens: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """How deep each piece's end is nested below the first one's beginning, which is ``inside`` a string or not, and
    whether its brace is outside strings."""
    opens = opens[(np.searchsorted(quotes, opens) + inside) % 2 == 0]
    closes = (np.searchsorted(quotes, ends) + inside) % 2 == 0
    return np.searchsorted(opens, ends) - np.cumsum(closes), closes


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of one split after the other: a task reads each from beginning to end."""
    path, split = batch["path"], batch["split"]
    other = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(split[1:], split[:-1]))
    starts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), len(batch)]
    for a, b in pairwise(starts if len(batch) else []):
        yield (path[a].as_py(), split[a].as_py()), batch.slice(a, b - a)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split's quotes, and the change of depth over it if it begins outside or inside a string."""
    held: dict[tuple[str, int], tuple[int, int, int]] = {}
    for batch in batches:
        for of, rows in _by_split(batch):
            quotes, *change = held.get(of, (0, 0, 0))
            _, ends, at, opens = _scanned(rows["value"])
            change = [change[i] + int(_depths(ends, at, opens, (quotes + i) % 2)[0][-1]) for i in (0, 1)]
            held[of] = (quotes + len(at), *change)
    rows = [(*of, *counts) for of, counts in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(5)],
                                     ["path", "split", "quotes", "even", "odd"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each record, from the end of the one before it; what a split holds of its last one, and
    what one that begins within a file holds of its first one, with path and split."""
    def rows(texts: list | pa.Array, of=(None, None), part=None, ended=None) -> pa.RecordBatch:
        n = len(texts)
        same = [pa.array([x], t) if n == 1 else pa.nulls(n, t) for x, t in
                ((of[0], pa.string()), (of[1], pa.int64()), (part, pa.int32()), (ended, pa.bool_()))]
        return pa.RecordBatch.from_arrays([texts, *same], ["text", "path", "split", "part", "ended"])

    def left() -> Iterator[pa.RecordBatch]:
        if any(held):
            yield rows(_texts(b"".join(held), np.array([sum(map(len, held))])), now, 0 if head else 1, False)

    now, inside, depth, held, head = None, 0, 0, [], False
    for batch in batches:
        for of, some in _by_split(batch):
            if of != now:
                yield from left()
                now, inside, depth, held, head = of, some["inside"][0].as_py(), some["depth"][0].as_py(), [], of[1] > 0
                if inside is None:
                    raise ValueError(f"{of[0]} was split otherwise when its quotes were counted, at {of[1]}")
            data, ends, quotes, opens = _scanned(some["value"])
            depths, closes = _depths(ends, quotes, opens, inside)
            cuts = ends[closes & (depths + depth == 0)]
            inside, depth = (inside + len(quotes)) % 2, depth + int(depths[-1])
            if not len(cuts):
                held.append(data.tobytes())
                continue
            texts = _texts(b"".join([*held, data[: cuts[-1]].tobytes()]), cuts + sum(map(len, held)))
            held = [data[cuts[-1] :].tobytes()]
            if head:
                yield rows(texts[:1], now, 0, True)
                texts, head = texts[1:], False
            if len(texts):
                yield rows(texts)
    yield from left()


def _texts(data: bytes, ends: np.ndarray) -> pa.Array:
    """One text after the other, up to each of ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data))


def _to_json_col(df: DataFrame):
    return F.to_json(F.struct(*df.columns))
