"""Event-stream queries (T1-T3) and the batched user-function map."""

from __future__ import annotations

from pyspark.sql import functions as F

from taffeta.functions.text import py_split_ws
from taffeta.operators import batches as U
from taffeta.operators import sessions as T
from taffeta.plans.corpus import PAIRS_CTE, flagship
from taffeta.plans.fixtures import duckdb_cte, taf_records
from taffeta.plans.registry import query
from taffeta.plans.sqlparts import split_ws
from taffeta.session import scratch_path
from taffeta.sources.tables import load_table
from taffeta.sources.text import write_corpus
from taffeta.streaming import ask as SA
from taffeta.streaming import debounce as SD
from taffeta.streaming import state as SS

GAP_MS = 600
WATERMARK_S = 10

def debounce_cte(gap_ms: int, events: str = "events") -> str:
    return f"""
with e as (select user_id, ts, value, event_id, epoch_us(ts) as us,
             lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as prev from {events}),
s as (select *, sum(case when prev is null or us - prev >= {gap_ms * 1000} then 1 else 0 end)
             over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as sid from e),
sessions as (select user_id, min(ts) as session_start, max(ts) as last_ts, count(*) as n_events,
             arg_max(value, (us, event_id)) as last_value,
             max(ts) + interval {gap_ms} millisecond as fire_ts from s group by user_id, sid)
"""


DEBOUNCE_CTE = debounce_cte(GAP_MS)


@query("debounce_events", DEBOUNCE_CTE + "select * from sessions")
def q_debounce_events(spark, sf_dir):
    return T.debounce(load_table(spark, sf_dir, "events"), gap_ms=GAP_MS)


@query("debounce_events_30m", debounce_cte(30 * 60 * 1000) + "select * from sessions")
def q_debounce_events_30m(spark, sf_dir):
    """Same operator with a 30-minute quiet gap, so bursts merge and cross hour buckets."""
    return T.debounce(load_table(spark, sf_dir, "events"), gap_ms=30 * 60 * 1000)


# Each event as keystrokes: up to six, 200 ms apart, after the third a pause longer than the editor's wait.
KEYS_SQL = """(select event_id * 8 + i as event_id, user_id, ts + to_milliseconds(i * 200 + i // 3 * 500) as ts, value + i as value
  from events, range(0, 6) r(i) where i <= event_id % 6)"""


def keystrokes(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    d = e.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 6).cast("int"))))
    wait = (F.col("i") * 200 + F.floor(F.col("i") / 3) * 500) / 1000.0
    return d.select((F.col("event_id") * 8 + F.col("i")).alias("event_id"), "user_id",
                    (F.col("ts") + F.make_dt_interval(secs=wait)).alias("ts"), (F.col("value") + F.col("i")).alias("value"))


@query("debounce_keys", debounce_cte(GAP_MS, KEYS_SQL) + "select * from sessions")
def q_debounce_keys(spark, sf_dir):
    return T.debounce(keystrokes(spark, sf_dir), gap_ms=GAP_MS)


def _landed(spark, events, name):
    """A folder that event files arrive in, a stream of it, and paths of a sink and a checkpoint."""
    landing = scratch_path(spark, name)
    events.write.parquet(landing)
    SS.close_input(events, landing)
    return spark.readStream.schema(events.schema).parquet(landing), scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")


@query("stream_debounce", debounce_cte(GAP_MS, KEYS_SQL) + "select user_id, session_start, last_ts, n_events, last_value from sessions")
def q_stream_debounce(spark, sf_dir):
    src, out, ck = _landed(spark, keystrokes(spark, sf_dir), "keystrokes")
    SS.run_available(SD.debounce_stream(src, gap_ms=GAP_MS, watermark=f"{WATERMARK_S} seconds"), out, ck,
                     partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(out)


def _typed(spark, sf_dir):
    """Each event's typed text: the first 3 + event_id % 8 words of its forecast; the completion
    shown afterwards is the whole forecast."""
    recs = taf_records(spark, sf_dir).select(F.col("rec_id").alias("event_id"), "text")
    ev = load_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    d = ev.join(recs, "event_id")
    k = (F.col("event_id") % 8 + 3).cast("int")
    return d.select("event_id", "user_id", "ts",
                    F.array_join(F.slice(py_split_ws("text"), 1, k), " ").alias("typed"),
                    F.col("text").alias("completion"))


ASK_SQL = duckdb_cte(["taf_records"]).replace("with ", "with recursive ", 1) + f"""
, d as (select e.event_id, e.user_id, e.ts, array_to_string({split_ws('r.text')}[1:(e.event_id % 8 + 3)], ' ') as typed,
          r.text as completion, row_number() over (partition by e.user_id order by e.ts, e.event_id) as n
        from events e join taf_records r on r.rec_id = e.event_id),
run as (select *, true as request, completion as shown from d where n = 1
        union all
        select d.*, not starts_with(run.shown, d.typed), case when starts_with(run.shown, d.typed) then run.shown else d.completion end
        from run join d on d.user_id = run.user_id and d.n = run.n + 1)
"""


@query("changed_prefix", ASK_SQL + "select event_id, user_id, typed, request from run")
def q_changed_prefix(spark, sf_dir):
    d = T.changed_prefix(_typed(spark, sf_dir), "user_id", "ts", "event_id", "typed", "completion")
    return d.select("event_id", "user_id", "typed", "request")


@query("stream_changed_prefix", ASK_SQL + "select event_id, typed, completion, request from run")
def q_stream_changed_prefix(spark, sf_dir):
    src, out, ck = _landed(spark, _typed(spark, sf_dir), "typed")
    asked = SA.changed_prefix_stream(src, "user_id", "ts", "event_id", "typed", "completion", f"{WATERMARK_S} seconds")
    SS.run_available(asked, out, ck, partitions=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(out)


@query("stream_prefix_pairs", PAIRS_CTE + "select prompt, completion from pairs")
def q_stream_prefix_pairs(spark, sf_dir):
    corpus, out, ck = (scratch_path(spark, n) for n in ("stream-corpus", "stream-pairs", "stream-ckpt"))
    # two micro-batches; the second brings the first one's records again besides its own
    recs = taf_records(spark, sf_dir)
    write_corpus(recs.where("rec_id % 2 = 0"), f"{corpus}/first")
    n = spark.sparkContext.defaultParallelism
    SD.run_prefix_pairs(spark, f"{corpus}/*", out, ck, partitions=n)
    write_corpus(recs, f"{corpus}/second")
    SD.run_prefix_pairs(spark, f"{corpus}/*", out, ck, partitions=n)
    return spark.read.parquet(out)


@query("map_batches", PAIRS_CTE + f"""
select prompt, completion, cast(len({split_ws('prompt')}) as bigint) as prompt_words,
       cast(len({split_ws('completion')}) as bigint) as completion_words from pairs
""")
def q_map_batches(spark, sf_dir):
    return U.map_batches(flagship(spark, sf_dir), U.word_counts,
                         "prompt string, completion string, prompt_words long, completion_words long", batch_size=1000)
