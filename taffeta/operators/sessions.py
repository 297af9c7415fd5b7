"""Event sequences per key without a window over a whole key (T1, T2 batch forms).

A hot key (one user with a third of all events) must not land in one task. Order-dependent
steps therefore run per (key, time bucket); what crosses a bucket edge is carried through a
small per-bucket summary (one row per key and non-empty bucket) whose window is per key over
buckets only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

HOUR_US = 3_600_000_000


def _micros(ts_col: str) -> F.Column:
    """Microseconds since the epoch, independent of the session time zone for TIMESTAMP_NTZ
    (a plain cast to TIMESTAMP would go through the session zone and its DST shifts)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts_col})")


def with_previous(df: DataFrame, key: str, ts_col: str, tie: str, cols, bucket_us: int = HOUR_US,
                  prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` on the previous row of the same key in (ts, tie) order."""
    d = df.withColumn("_wp_us", _micros(ts_col)).withColumn("_wp_b", F.floor(F.col("_wp_us") / bucket_us))
    w_in = Window.partitionBy(key, "_wp_b").orderBy("_wp_us", tie)
    d = d.withColumns({prefix + c: F.lag(c).over(w_in) for c in cols})
    last = F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]), F.struct("_wp_us", tie))
    summ = d.groupBy(key, "_wp_b").agg(last.alias("_wp_last"))
    summ = summ.withColumn("_wp_carry", F.lag("_wp_last").over(Window.partitionBy(key).orderBy("_wp_b")))
    d = d.join(summ.select(key, "_wp_b", "_wp_carry"), [key, "_wp_b"])
    first_in_bucket = F.row_number().over(w_in) == 1
    d = d.withColumns({prefix + c: F.when(first_in_bucket, F.col("_wp_carry")[c]).otherwise(F.col(prefix + c))
                       for c in cols})
    return d.drop("_wp_carry", "_wp_b", "_wp_us")


def debounce(events: DataFrame, key: str = "user_id", ts_col: str = "ts", value_col: str = "value",
             tie: str = "event_id", gap_ms: int = 600, bucket_us: int = HOUR_US) -> DataFrame:
    """T1 (batch): trailing-edge debounce. A burst ends when the next event of the key comes
    ``gap_ms`` or more later; per burst emit the last value, fired at last ts + gap.

    Session starts come from the previous-event helper; the session each event belongs to is
    the latest start at or before it, found per (key, bucket) plus a carried start from
    earlier buckets. The final group-by has only partial-aggregatable functions (min, max,
    count, max_by), so a very long burst is combined map-side.
    """
    gap_us = gap_ms * 1000
    d = events.select(key, ts_col, value_col, tie).withColumn("_us", _micros(ts_col))
    d = with_previous(d, key, ts_col, tie, ["_us"], bucket_us)
    d = d.withColumn("_start", F.when(F.col("prev__us").isNull() | (F.col("_us") - F.col("prev__us") >= gap_us),
                                      F.col("_us")))
    d = d.withColumn("_b", F.floor(F.col("_us") / bucket_us))
    w_in = Window.partitionBy(key, "_b").orderBy("_us", tie).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s_in", F.max("_start").over(w_in))
    summ = d.groupBy(key, "_b").agg(F.max("_start").alias("_bs"))
    summ = summ.withColumn("_carry", F.max("_bs").over(
        Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    d = d.join(summ.select(key, "_b", "_carry"), [key, "_b"])
    d = d.withColumn("_session", F.coalesce("_s_in", "_carry"))
    out = d.groupBy(key, "_session").agg(
        F.min(ts_col).alias("session_start"), F.max(ts_col).alias("last_ts"),
        F.count(F.lit(1)).alias("n_events"),
        F.max_by(value_col, F.struct("_us", tie)).alias("last_value"))
    return out.drop("_session").withColumn(
        "fire_ts", F.col("last_ts") + F.make_dt_interval(secs=F.lit(gap_ms / 1000.0)))


def asks(shown: str | None, typed: str | None) -> bool:
    """Whether typed text needs a new completion: none is shown, or it doesn't begin with the text."""
    return not shown or not shown.startswith(typed or "")


class Transition:
    """What a run of events makes of whatever completion was shown before it.

    A completion lives on while it begins with each typed text. Those that lived so far begin with the
    longest text so far, so only a longer text, or one that differs from it, can end some of them: one entry
    for each such text, with what is shown in the end if it ended there. The texts grow, so there are at
    most as many entries as characters in the longest."""

    def __init__(self):
        self.entries: list[list] = []
        self.closed = False

    def add(self, typed: str | None, completion: str | None) -> None:
        typed = typed or ""
        for entry in self.entries:
            if asks(entry[1], typed):
                entry[1] = completion
        longest = self.entries[-1][0] if self.entries else None
        if not self.closed and (longest is None or not longest.startswith(typed)):
            self.closed = longest is not None and not typed.startswith(longest)
            self.entries.append([typed, completion])

    @staticmethod
    def apply(entries, shown: str | None) -> str | None:
        for typed, then in entries:
            if asks(shown, typed):
                return then
        return shown


def _groups(batches, keys):
    """Runs of rows with equal ``keys``, from batches of sorted rows, as (key, row) with a first-of-run flag."""
    before = None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            yield key, key != before, row
            before = key


def _typed_schema(df: DataFrame, columns: list[str], more: list[T.StructField]) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in columns), *more])


def _record_batches(rows, schema: T.StructType, size: int = 10_000):
    names, arrow = schema.names, to_arrow_schema(schema)
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(arrow)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(arrow)], names=names)


def changed_prefix(df: DataFrame, key: str, ts_col: str, tie: str, text_col: str,
                   completion_col: str, bucket_us: int = HOUR_US) -> DataFrame:
    """T2 (batch): ``request``, whether the event asks for a completion: what is shown does not begin
    with the typed text, or nothing is shown. What is shown changes only when an event asked; then it is
    that event's completion. Whether an event asks therefore depends on what all earlier ones did.

    Each (key, time bucket) becomes a ``Transition``, a short summary that is correct for any completion shown
    before; a key's summaries, one for each bucket, are folded in order; then each bucket's events are
    run from what the fold shows at its start. A task holds one summary; a hot key's events are spread
    over its buckets.
    """
    events = df.withColumn("_us", _micros(ts_col)).withColumn("_bucket", F.floor(F.col("_us") / bucket_us))
    bucket = T.StructField("_bucket", T.LongType())
    state = T.ArrayType(T.StructType([T.StructField("typed", T.StringType()), T.StructField("shown", T.StringType())]))
    summaries_schema = _typed_schema(df, [key], [bucket, T.StructField("_entries", state)])
    shown_schema = _typed_schema(df, [key], [bucket, T.StructField("_shown", T.StringType())])
    columns = df.columns
    out_schema = _typed_schema(df, columns, [T.StructField("request", T.BooleanType())])

    def summarise(batches):
        def rows():
            at, transition = None, None
            for where, new, row in _groups(batches, (key, "_bucket")):
                if new:
                    if transition:
                        yield *at, [{"typed": t, "shown": s} for t, s in transition.entries]
                    at, transition = where, Transition()
                transition.add(row[text_col], row[completion_col])
            if transition:
                yield *at, [{"typed": t, "shown": s} for t, s in transition.entries]
        return _record_batches(rows(), summaries_schema)

    def fold(batches):
        def rows():
            shown = None
            for where, new, row in _groups(batches, (key,)):
                shown = None if new else shown
                yield *where, row["_bucket"], shown
                shown = Transition.apply([(e["typed"], e["shown"]) for e in row["_entries"]], shown)
        return _record_batches(rows(), shown_schema)

    def run(batches):
        def rows():
            shown = None
            for _, new, row in _groups(batches, (key, "_bucket")):
                if row["_start"]:
                    shown = row["_shown"]
                    continue
                request = asks(shown, row[text_col])
                shown = row[completion_col] if request else shown
                yield *(row[c] for c in columns), request
        return _record_batches(rows(), out_schema)

    spread = events.select(key, "_bucket", "_us", tie, text_col, completion_col).repartition(key, "_bucket")
    summaries = spread.sortWithinPartitions(key, "_bucket", "_us", tie).mapInArrow(summarise, summaries_schema)
    starts = summaries.repartition(key).sortWithinPartitions(key, "_bucket").mapInArrow(fold, shown_schema)
    both = events.withColumns({"_shown": F.lit(None).cast("string"), "_start": F.lit(False)}) \
                 .unionByName(starts.withColumn("_start", F.lit(True)), allowMissingColumns=True)
    both = both.repartition(key, "_bucket").sortWithinPartitions(key, "_bucket", F.col("_start").desc(), "_us", tie)
    return both.mapInArrow(run, out_schema)
