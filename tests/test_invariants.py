"""Invariants over the driver tables (sf0.001)."""

import math

from pyspark.sql import functions as F

from taffeta.functions.text import py_split_ws
from taffeta.operators import distributions as N
from taffeta.operators import metadata as M
from taffeta.operators import prefixes as G
from taffeta.operators import splits as W
from taffeta.operators.ranking import global_rank
from taffeta.plans import catalog
from taffeta.plans.fixtures import taf_records
from taffeta.session import scratch_path
from taffeta.sources import text


def test_prefix_counts_and_rejoin(spark, sf_small):
    recs = M.template_records(taf_records(spark, sf_small))
    norm = recs.select(F.array_join(py_split_ws("templated"), " ").alias("t")).dropDuplicates()
    expected = norm.select(F.sum(F.size(F.split("t", " ")) - 1)).first()[0]
    pairs = G.prefix_pairs(norm, "t", dedup=False)
    assert pairs.count() == expected
    # prompt (without BOS and its trailing space) + completion (without EOS) = the record
    rejoined = pairs.select(F.concat(F.expr("substring(prompt, 8)"),
                                     F.expr("substring(completion, 1, length(completion) - 7)")).alias("t"))
    assert rejoined.join(norm, "t", "left_anti").count() == 0


def test_dedup_before_expansion_equals_after(spark, sf_small):
    recs = M.template_records(taf_records(spark, sf_small))
    a = G.prefix_pairs(recs, "templated", dedup=True)
    b = G.prefix_pairs(recs, "templated", dedup=False).dropDuplicates()
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_exact_split_sizes(spark, sf_small):
    pairs = catalog.QUERIES["prefix_pairs"](spark, sf_small)
    n = pairs.count()
    s = W.train_test_split(pairs, ["prompt", "completion"], 0.2)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["test"] == math.ceil(0.2 * n) and counts["test"] + counts["train"] == n
    assert s.select("prompt", "completion").distinct().count() == n


def test_kth_smallest_matches_sort(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("h"))
    vals = sorted(r.h for r in df.collect())
    for k in (1, 2, 777, 2500, 4999, 5000):
        value, nth = W.kth_smallest(df, F.col("h"), k)
        assert value == vals[k - 1] and nth == k - vals.index(value)
    assert W.kth_smallest(df, F.col("h"), 0) is None


def test_split_sizes_with_repeated_keys(spark):
    rows = [("a",)] * 9 + [("b",)]
    s = W.train_test_split(spark.createDataFrame(rows, "k string").repartition(3), ["k"], 0.2)
    assert s.where("split = 'test'").count() == 2 and s.count() == 10 and s.columns == ["k", "split"]


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("v")).repartition(7)
    r = global_rank(df, ["v"]).collect()
    assert sorted(x["rank"] for x in r) == list(range(1, 2001))
    assert all(x["rank"] == x.v + 1 for x in r)


def test_shaped_distributions_sum_to_one(spark, sf_small):
    from taffeta.plans.distributions import taf_model
    shaped = N.shape_by_strategy(taf_model(spark, sf_small))
    sums = shaped.groupBy("strategy", "context").agg(F.sum("p").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_line_mode_equals_whole_file_mode(spark, sf_small):
    path = scratch_path(spark, "test-corpus")
    text.write_corpus(taf_records(spark, sf_small).repartition(3), path)
    a = text.scan_records(spark, path).select("text")
    b = text.scan_records_by_line(spark, path).select("text")
    assert a.count() == b.count() == taf_records(spark, sf_small).count()
    assert a.exceptAll(b).count() == 0


def test_split_by_record_is_group_safe(spark, sf_small):
    d = catalog.QUERIES["split_by_record"](spark, sf_small)
    rec = d.select(F.expr("substring(prompt, 8)").alias("p"), "completion", "split") \
           .select(F.concat("p", F.expr("substring(completion, 1, length(completion) - 7)")).alias("t"), "split")
    assert rec.groupBy("t").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_save_if_absent_keeps_first(spark):
    from taffeta.sources import store
    path = scratch_path(spark, "test-ignore")
    store.save_if_absent(spark.range(5), path)
    store.save_if_absent(spark.range(100), path)
    assert spark.read.parquet(path).count() == 5


def test_debounce_hot_user_matches_brute_force(spark):
    """One user holds a third of all events, spread over many hour buckets; the bucketed
    operator must equal a direct per-user scan."""
    import datetime as dt
    import random

    from taffeta.operators.sessions import debounce
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for user, n in ((1, 3000), (2, 3000), (3, 3000)):
        t = base
        for _ in range(n if user != 1 else 4500):
            t = t + dt.timedelta(seconds=rnd.choice([1, 2, 5, 30, 200, 900, 2000, 4000]))
            rows.append((eid, t, user, float(eid % 97)))
            eid += 1
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    gap_ms = 600_000
    got = {(r.user_id, r.session_start, r.n_events, r.last_value) for r in debounce(df, gap_ms=gap_ms).collect()}
    expected = set()
    by_user = {}
    for e, t, u, v in rows:
        by_user.setdefault(u, []).append((t, e, v))
    for u, evs in by_user.items():
        evs.sort()
        start, n, last, prev = None, 0, None, None
        for t, e, v in evs:
            if prev is not None and (t - prev) >= dt.timedelta(milliseconds=gap_ms):
                expected.add((u, start, n, last))
                start, n = None, 0
            if start is None:
                start = t
            n, last, prev = n + 1, v, t
        expected.add((u, start, n, last))
    assert got == expected


def test_cap_per_station_hot_station_matches_brute_force(spark):
    """A third of all rows on one station: the salted two-stage top-k equals a direct sort."""
    import hashlib

    from taffeta.operators.metadata import cap_per_station
    rows = [(i, "KHOT" if i % 3 == 0 else f"K{i % 7:03d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "rec_id long, icao string")
    stations = ["KHOT", "K001", "K002"]
    got = {(r.rec_id, r.icao) for r in cap_per_station(df, stations, cap=100).collect()}
    expected = set()
    for s in stations:
        keys = sorted((hashlib.md5(f"taffeta{i}".encode()).hexdigest(), i) for i, st in rows if st == s)
        expected |= {(i, s) for _, i in keys[:100]}
    assert got == expected
