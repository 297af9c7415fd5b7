"""Input that must not be lost or mangled: CR LF corpora, empty texts, late files, hot keys."""

import pytest
from pyspark.sql import functions as F

from taffeta.operators import tokens as K
from taffeta.operators.sessions import changed_prefix, debounce
from taffeta.session import ensure_checkpoint_dir, scratch_path
from taffeta.sources import text
from taffeta.streaming import debounce as SD
from taffeta.streaming import state as SS
from taffeta.streaming.ask import changed_prefix_stream


def put(spark, path, body, name="a.txt"):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(body.encode()))
    out.close()


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_corpora_with_any_newline(spark, newline):
    path = scratch_path(spark, "test-newlines")
    put(spark, path, newline.join(["TAF one", "###", "TAF two", "  second line", "", "##", "TAF three ", ""]))
    want = ["TAF one", "TAF three", "TAF two\n  second line"]
    assert sorted(r.text for r in text.scan_records(spark, path).collect()) == want
    assert sorted(r.text for r in text.scan_records_by_line(spark, path).collect()) == want


def test_delimited_records_are_stripped(spark):
    path = scratch_path(spark, "test-delimited")
    put(spark, path, "A\n###\n  C pad  \n###\n")
    assert [r.value for r in text.read_delimited(spark, path).collect()] == ["A", "C pad"]


def test_texts_without_tokens_keep_their_place(spark):
    vocab = K.build_vocab(spark.createDataFrame([("x",), ("y",), ("x",)], "token string"))
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, []), (3, ["none", "NO"]), (4, None)], "id long, tokens array<string>")
    coded = K.encode(docs, ["id"], vocab)
    ids = {r.id: r.ids for r in coded.collect()}
    assert ids == {1: [len(K.RESERVED), len(K.RESERVED) + 1], 2: [], 3: [None, K.RESERVED.index("NO")], 4: []}
    assert {r.id: r.text for r in K.decode(coded, ["id"], vocab).collect()} == {1: "x y", 2: "", 3: "", 4: ""}


def test_late_files_and_copies_in_a_stream(spark):
    taf = "TAF KFFO 010000Z 0100/0124 9999 TX{}/0120Z TN01/0111Z"
    path, out, checkpoint = (scratch_path(spark, f"test-stream-{n}") for n in ("in", "out", "checkpoint"))
    put(spark, path, taf.format("11") + "\n###\n" + taf.format("12"))
    SD.run_prefix_pairs(spark, path, out, checkpoint)
    put(spark, path, taf.format("12") + "\n###\n" + taf.format("13"), "late.txt")
    late = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/late.txt")
    late.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(late, 1_000_000, -1)
    SD.run_prefix_pairs(spark, path, out, checkpoint)
    pairs = spark.read.parquet(out)
    assert pairs.where(F.col("prompt").contains("TX13")).count() > 0
    assert pairs.count() == pairs.select("prompt", "completion").distinct().count()


def test_a_micro_batch_looks_up_its_own_records_only(spark):
    taf = "TAF KFFO 010000Z 0100/0124 9999 TX{}/0120Z TN01/0111Z"
    path, out, checkpoint = (scratch_path(spark, f"test-keyed-{n}") for n in ("in", "out", "checkpoint"))
    for i in range(3):
        put(spark, path, "\n###\n".join(taf.format(f"{x:02d}") for x in (10 + i, 11 + i)), f"{i}.txt")
        SD.run_prefix_pairs(spark, path, out, checkpoint, partitions=2)
    read = spark.read.format("statestore").load(checkpoint)
    assert len(read.collect()) == 4  # one key for each record, whatever the batches
    assert spark.read.parquet(out).where(F.col("prompt").contains("]")).select(F.substring_index("prompt", "]", 1)).distinct().count() == 4


EVENTS = "event_id long, user_id string, ts timestamp_ntz, value double, typed string, completion string"


def _landed(spark, rows, files):
    path = scratch_path(spark, "test-events")
    d = spark.createDataFrame(rows, "event_id long, user_id string, s double, value double, typed string, completion string")
    d = d.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)")).select(*[f.split()[0] for f in EVENTS.split(", ")])
    for i in range(files):
        d.where(F.col("event_id") % files == i).coalesce(1).write.mode("append").parquet(path)
    SS.close_input(d, path)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(path), d


def test_all_sessions_of_a_stream_come_out(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [(i, "uv"[i % 2] if i < 30 else None, i // 7 * 2.0 + i * 0.05, float(i), "", "") for i in range(40)]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        stream, d = _landed(spark, rows, 3)
        out = scratch_path(spark, "test-out")
        SS.run_available(SD.debounce_stream(stream, gap_ms=600, watermark="60 seconds"), out, scratch_path(spark, "test-ckpt"), partitions=2)
        got = spark.read.parquet(out).select("user_id", "session_start", "last_ts", "n_events", "last_value").collect()
        want = debounce(d.where("user_id is not null"), gap_ms=600).select("user_id", "session_start", "last_ts", "n_events", "last_value").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(g for g in got if g.user_id) == sorted(want) and max(w.n_events for w in want) > 1
    assert sum(g.n_events for g in got) == 40


def test_ask_again_on_a_stream_keeps_what_is_shown(spark):
    rows = [(0, "u", 1.0, 0.0, "AB", "AB x y"), (1, "u", 2.0, 0.0, "AB x", "other"), (2, "u", 3.0, 0.0, "AB x y", "third"),
            (3, "w", 3.5, 0.0, "", None), (4, "w", 4.0, 0.0, "", "k"), (5, "u", 5.0, 0.0, "AB z", "AB z q"), (6, "w", 6.0, 0.0, "k", "l"),
            (7, "u", 900.0, 0.0, "AB z q", "later"), (8, "u", 901.0, 0.0, "C", ""),
            (9, None, 5.0, 0.0, "AB x", "AB x y"), (10, None, 6.0, 0.0, "AB", "k")]
    stream, d = _landed(spark, rows, 4)
    out = scratch_path(spark, "test-ask")
    asked = changed_prefix_stream(stream, "user_id", "ts", "event_id", "typed", "completion", "1 hour")
    SS.run_available(asked, out, scratch_path(spark, "test-ask-ckpt"), partitions=2)
    got = {r.event_id: r.request for r in spark.read.parquet(out).collect()}
    assert [got[i] for i in range(11)] == [True, False, False, True, True, True, False, False, True, True, False]
    batch = changed_prefix(d, "user_id", "ts", "event_id", "typed", "completion")
    assert {r.event_id: r.request for r in batch.collect()} == got


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_scratch_keeps_the_folders_file_system(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext.getCheckpointDir())


def test_all_listed_stations_are_capped(spark, sf_small):
    from taffeta.plans import catalog
    from taffeta.plans.fixtures import taf_records
    got = catalog.QUERIES["cap_per_station"](spark, sf_small).groupBy("icao").count().collect()
    assert len(got) == taf_records(spark, sf_small).select("icao").distinct().count() and all(r["count"] <= 100 for r in got)


@pytest.mark.parametrize("small", [200_000, 3])
def test_rows_of_one_key_and_hot_words_are_coded_apart(spark, monkeypatch, small):
    from taffeta.operators import joins
    monkeypatch.setattr(joins, "SMALL", small)
    rows = [(1, ["hot"] * 3), (1, ["x", "hot"]), (None, ["hot"]), (None, []), (2, None), (2, ["hot", None, "y"])]
    rows += [(3, ["hot"] * 50) for _ in range(40)] + [(4, [f"w{i}", "hot"]) for i in range(200)]
    d = spark.createDataFrame(rows, "k long, tokens array<string>").repartition(3)
    from taffeta.functions.generators import explode_rows
    vocab = K.build_vocab(explode_rows(d, [], F.col("tokens"), "token").where("token is not null"))
    ids = {r.token: r.id for r in vocab.collect()}
    coded = K.encode(d, ["k"], vocab)
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    want = [(k, [ids.get(t) for t in tokens or []]) for k, tokens in rows]
    assert sorted(((r.k, r.ids) for r in coded.collect()), key=key) == sorted(want, key=key)
    texts = [(k, " ".join(t for t in tokens or [] if t)) for k, tokens in rows]
    assert sorted(((r.k, r.text) for r in K.decode(coded, ["k"], vocab).collect()), key=key) == sorted(texts, key=key)


def test_no_pair_text_is_stored_for_splits_and_batches(spark, sf_small, monkeypatch):
    from taffeta import session
    from taffeta.plans import catalog
    catalog.QUERIES["prefix_pairs"](spark, sf_small)
    for name in ("train_test_split", "pad_batch"):
        made = len(session.scratch_made())
        out = catalog.QUERIES[name](spark, sf_small)
        stored = [spark.read.parquet(p).columns for p in session.scratch_made()[made:] if "fixture" not in p]
        assert stored and not any({"prompt", "completion"} & set(c) for c in stored)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any("Sort [" in line and "prompt" in line for line in plan.splitlines())


def test_batches_have_the_size_that_is_asked_for(spark):
    import pandas as pd
    from taffeta.operators.batches import map_batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for size, want in ((8, [8, 8, 8, 6]), (5, [5] * 6), (100, [30]), (None, [7, 7, 7, 7, 2])):
            got = map_batches(spark.range(0, 30, 1, 1), lambda b: pd.DataFrame({"n": [len(b)], "s": [int(b["id"].sum())]}), "n long, s long", size).collect()
            assert [r.n for r in got] == want and sum(r.s for r in got) == sum(range(30))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_artefact_is_built_once(spark):
    import threading
    from taffeta.sources.store import build_if_absent
    path, calls, lock = scratch_path(spark, "test-artefact"), [], threading.Lock()

    def build():
        with lock:
            calls.append(1)
        return spark.range(5)

    builders = [threading.Thread(target=lambda: build_if_absent(spark, path, build, poll_s=0.05)) for _ in range(4)]
    for b in builders:
        b.start()
    for b in builders:
        b.join()
    assert len(calls) == 1 and build_if_absent(spark, path, build).count() == 5 and len(calls) == 1
    other = scratch_path(spark, "test-failed")
    with pytest.raises(ValueError):
        build_if_absent(spark, other, lambda: (_ for _ in ()).throw(ValueError("no")))
    put(spark, other.rsplit("/", 1)[0], "", other.rsplit("/", 1)[1] + ".claim")  # of an application that died
    assert build_if_absent(spark, other, build, stale_s=-1).count() == 5


def test_events_of_a_batch_wait_as_one_value_of_state():
    import pandas as pd
    from taffeta.streaming.ask import Asking
    calls, timers = [], set()

    class State:
        def __init__(self):
            self.held = []

        def exists(self):
            calls.append("exists")
            return bool(self.held)

        def get(self):
            calls.append("get")
            return self.held[0] if self.value else iter(self.held)

        def update(self, value):
            calls.append("update")
            self.held = [value]

        def appendValue(self, value):
            calls.append("append")
            self.held.append(value)

        def put(self, values):
            calls.append("put")
            self.held = values

        def clear(self):
            calls.append("clear")
            self.held = []

    class Handle:
        def getValueState(self, name, schema):
            return type("Value", (State,), {"value": True})()

        def getListState(self, name, schema):
            return type("Several", (State,), {"value": False})()

        def registerTimer(self, at):
            calls.append("timer")
            timers.add(at)

    asking = Asking(["event_id", "typed", "completion"])
    asking.init(Handle())
    rows = [(3, "AB x y", "third", 30_000_000, False), (1, "AB", "AB x y", 10_000_000, False), (2, "AB x", None, 20_000_000, False), (0, None, None, 99_000_000_000, True)]
    frame = pd.DataFrame(rows, columns=["event_id", "typed", "completion", "event_us", "event_closes"])
    assert list(asking.handleInputRows(("u",), iter([frame]), None)) == [] and calls == ["append", "timer"] and timers == {10_000}
    assert list(asking.handleInputRows(("u",), iter([frame.tail(1)]), None)) == [] and len(calls) == 2
    got = []
    for passed in (5_000, 20_001, 40_000):
        now = type("Now", (), {"getCurrentWatermarkInMs": lambda self, at=passed: at})()
        got.append([(r.event_id, r.request) for out in asking.handleExpiredTimer(("u",), now, None) for r in out.itertuples()])
    assert got == [[], [(1, True), (2, False)], [(3, False)]]
    assert timers == {10_000, 30_000} and asking.waiting.held == []


def test_pairs_are_cut_by_bytes_from_both_ends(spark):
    from taffeta.operators.prefixes import prefix_pairs
    texts = ["é😀 漢字  b", " a é é ", "one", "", None, "x y", "x  y"]
    pairs = prefix_pairs(spark.createDataFrame([(t,) for t in texts], "templated string"), "templated", "<", ">")
    want = {(f"<{' '.join(w[:i])} ", f"{' '.join(w[i:])}>") for t in texts for w in [(t or "").split()] for i in range(1, len(w))}
    got = [tuple(r) for r in pairs.collect()]
    assert sorted(got) == sorted(want)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "length(" not in plan and "substring(" not in plan
