"""Raw text corpora (S1, P1 at file scale)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taffeta.functions.generators import posexplode_rows
from taffeta.functions.text import py_strip
from taffeta.operators.segment import segment_records
from taffeta.session import materialise

RECORD_DELIMITER = "\n###\n"

#: Lines of a split are numbered and summed in runs of at most two to this power: what one window holds at once.
RUN_BITS = 16


def write_corpus(df: DataFrame, path: str, text_col: str = "text",
                 delimiter: str = RECORD_DELIMITER) -> None:
    """Write records as raw text files, each record followed by the delimiter (one file per
    partition, as any Spark text sink)."""
    df.select(F.col(text_col).alias("value")).write.option("lineSep", delimiter).text(path)


def universal_newlines(c) -> F.Column:
    """CR LF and lone CR become LF, as Python's text mode reads files."""
    return F.regexp_replace(c, "\r\n?", "\n")


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (``path``, ``value``), newlines made universal. Good for many modest
    files; a file must fit in one row (about 2 GB)."""
    return (spark.read.text(path, wholetext=True)
                 .select(F.col("_metadata.file_path").alias("path"), universal_newlines("value").alias("value")))


def read_delimited(spark: SparkSession, path: str, delimiter: str = RECORD_DELIMITER) -> DataFrame:
    """Fixed-delimiter records straight from the reader (``lineSep`` takes bytes, not a regex),
    stripped. A corpus with CR LF newlines needs its own ``delimiter``."""
    return spark.read.text(path, lineSep=delimiter).select(py_strip(universal_newlines("value")).alias("value"))


def scan_records(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """S1 + P1 + P2 on whole files: split on ``\\n+#+\\n+`` and strip."""
    recs = segment_records(read_whole_files(spark, path), "value", keep=("path",))
    return recs if keep_empty else recs.where(F.col("text") != "")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files with their places: (path, split, mid, sub, value), and whether they begin or end a file.
    The reader cuts files into byte ranges and at LF; a CR before it goes, and what a lone CR divides becomes
    lines of its own. ``split`` is a byte range's start and a run of lines in it, so that however large the
    ranges are, rows with one ``split`` are few. No line is shuffled; the broadcast has one row for each file."""
    run = F.shiftright(F.monotonically_increasing_id(), RUN_BITS)
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.struct(F.col("_metadata.file_block_start").alias("at"), run.alias("run")).alias("split"),
        F.monotonically_increasing_id().alias("mid"), "value")
    # one byte for each LF: a file whose lines and LFs make more than its size has none at its end
    ends = raw.groupBy("path").agg((F.sum(F.octet_length("value") + 1) > F.max("size")).alias("_open"), F.max("mid").alias("_last"),
                                   F.min(F.struct("split.at", "mid")).alias("_first"))
    raw = raw.join(F.broadcast(ends), "path")
    at_end = F.col("_open") & (F.col("mid") == F.col("_last"))
    at_start = (F.col("_first.at") == 0) & (F.col("mid") == F.col("_first.mid"))
    text = F.when(at_end, F.col("value")).otherwise(F.regexp_replace("value", r"\r\z", ""))
    raw = raw.select("path", "split", "mid", at_end.alias("_end"), at_start.alias("_start"), F.split(text, "\r", -1).alias("_parts"))
    keep = ["path", "split", "mid", "_end", "_start", "_n"]
    lines = posexplode_rows(raw.withColumn("_n", F.size("_parts")), keep, F.col("_parts"), "sub", "value")
    # only the very last piece of a file is without a newline after it
    return lines.withColumn("_end", F.col("_end") & (F.col("sub") == F.col("_n") - 1)) \
                .withColumn("_start", F.col("_start") & (F.col("sub") == 0)).drop("_n")


def scan_records_by_line(spark: SparkSession, path: str, delimiter_line: str = r"^#+$", keep_empty: bool = False) -> DataFrame:
    """S1 + P1 + P2 for files of any size: the records that ``scan_records`` finds, rebuilt from lines, so
    that one file is read by many tasks and only a record has to fit in a row.

    ``\\n+#+\\n+`` on the whole text means, in lines: a line of ``#`` divides if a newline stands before and
    after it which no divider has taken. The first line and an unended last one therefore don't; of
    several with nothing but empty lines between them, each second one is text. A line's answer depends
    on how many came since the last line of text, and its record on how many divided before it: two
    prefix sums, each within a run of a split's lines and then over the totals of a file's runs.
    """
    lines = _lines(spark, path)
    order = ["mid", "sub"]
    file_start = F.col("_start")
    mark = F.col("value").rlike(delimiter_line) & ~F.col("_end") & ~file_start
    lines = lines.withColumn("_mark", mark.cast("long")).withColumn("_text", (~mark & ((F.col("value") != "") | file_start)).cast("long"))
    lines = materialise(lines.drop("_start", "_end"), "lines")  # marks are summed, then the lines are read again

    in_split = Window.partitionBy("path", "split").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumns({"_texts": F.sum("_text").over(in_split), "_marks": F.sum("_mark").over(in_split)})
    d = d.withColumn("_since", F.col("_marks") - F.coalesce(F.max(F.when(F.col("_text") == 1, F.col("_marks"))).over(in_split), F.lit(0)))
    # marks after the last text of each split, carried over splits without any
    totals = lines.groupBy("path", "split").agg(F.sum("_text").alias("_t"), F.sum("_mark").alias("_m"))
    tail = d.where("_mark = 1").groupBy("path", "split").agg(F.max_by("_since", F.struct(*order)).alias("_after"), F.max_by("_texts", F.struct(*order)).alias("_at"))
    totals = totals.join(tail, ["path", "split"], "left")
    after = F.when(F.col("_at") == F.col("_t"), F.col("_after")).otherwise(0)
    totals = totals.withColumn("_after", F.coalesce(after, F.lit(0)))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    has_text = F.col("_t") > 0
    totals = totals.withColumn("_sum", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    # all marks so far less those at the last split that had text, plus what it left open
    base = F.last(F.when(has_text, F.struct((F.col("_sum") + F.col("_m")).alias("s"), F.col("_after").alias("a"))), ignorenulls=True).over(before)
    totals = totals.withColumn("_carry", F.coalesce(F.col("_sum") - base["s"] + base["a"], F.col("_sum")))
    d = d.join(totals.select("path", "split", "_carry"), ["path", "split"])
    run = F.col("_since") + F.when(F.col("_texts") == 0, F.col("_carry")).otherwise(0)
    d = d.withColumn("_divides", ((F.col("_mark") == 1) & (run % 2 == 1)).cast("long"))
    d = d.withColumn("_before", F.sum("_divides").over(in_split))
    dividers = d.groupBy("path", "split").agg(F.sum("_divides").alias("_n"))
    offsets = dividers.select("path", "split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    d = d.join(offsets, ["path", "split"]).withColumn("record", F.col("_off") + F.col("_before"))

    body = d.where("_divides = 0").groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("split", "mid", "sub", "value"))).alias("ls"))
    out = body.select("path", "record", py_strip(F.array_join(F.transform("ls", lambda x: x["value"]), "\n")).alias("text"))
    if not keep_empty:
        return out.where(F.col("text") != "")
    every = dividers.groupBy("path").agg(F.sum("_n").alias("_n")).select("path", F.explode(F.sequence(F.lit(0).cast("long"), "_n")).alias("record"))
    return every.join(out, ["path", "record"], "left").withColumn("text", F.coalesce("text", F.lit("")))
