"""Steps that grow with the input: what they shuffle, sort and hold, and that their rows stay the same."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from taffeta.operators import distributions as N
from taffeta.operators import tokens as K
from taffeta.operators.ranking import hashed_rank
from taffeta.session import open_writers
from taffeta.sources import jsonl, store, text


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


VOCAB = "token string, id bigint, count bigint"


def test_small_vocabularies_are_looked_up_without_a_shuffle(spark):
    vocab = spark.createDataFrame([("<|pad|>", 0, None), ("a", 7, 2), ("b", 8, 1), (None, 9, 1)], VOCAB)
    docs = spark.createDataFrame([(1, ["b", "x", None, "a"]), (1, []), (None, None), (2, ["a", "<|pad|>", "b"])], "k int, tokens array<string>")
    coded = K.encode(docs, ["k"], vocab)
    assert "Exchange" not in plan(coded)
    rows = coded.collect()
    assert [(r.k, r.ids) for r in rows] == [(1, [8, None, None, 7]), (1, []), (None, []), (2, [7, 0, 8])]
    assert K.encode(docs, ["k"], vocab, unk_id=5).first().ids == [8, 5, 5, 7]
    words = K.decode(coded, ["k"], vocab)
    assert "Exchange" not in plan(words)
    assert [(r.k, r.text) for r in words.collect()] == [(1, "b a"), (1, ""), (None, ""), (2, "a b")]


def test_a_repeated_word_still_gives_all_its_ids(spark):
    vocab = spark.createDataFrame([("a", 7, 2), ("a", 8, 1)], VOCAB)
    docs = spark.createDataFrame([(1, ["a"])], "k int, tokens array<string>")
    assert sorted(K.encode(docs, ["k"], vocab).first().ids) == [7, 8]


def test_batches_by_digest_equal_batches_by_rank(spark):
    d = spark.range(1003).select("id", F.unhex(F.md5(F.col("id").cast("string"))).alias("h"), (F.col("id") % 37).cast("int").alias("n"))
    order = sorted(d.collect(), key=lambda r: bytes(r.h))
    assert [r.id for r in hashed_rank(d, "h", "r").orderBy("r").collect()] == [r.id for r in order]
    for multiple in (None, 20):
        want = {}
        for i, r in enumerate(order):
            longest = max(x.n for x in order[i // 8 * 8 : i // 8 * 8 + 8])
            want[r.id] = (i // 8, -(-longest // 20) * 20 if multiple else longest)
        got = K.batch_cuts(d, ["h"], {"n": "target"}, multiple=multiple).collect()
        assert {r.id: (r.batch, r.target) for r in got} == want


def test_batches_shuffle_short_digests_and_let_their_shuffle_go(spark, monkeypatch):
    seen, store = [], K.materialise
    monkeypatch.setattr(K, "materialise", lambda d, name: seen.append(plan(d)) or store(d, name))
    monkeypatch.setattr(K, "drop_shuffles", lambda s: seen.append("dropped"))
    d = spark.range(40).select("id", F.unhex(F.md5(F.col("id").cast("string"))).alias("h"), F.lit(3).alias("n"))
    order = {r.id: i for i, r in enumerate(sorted(d.collect(), key=lambda r: bytes(r.h)))}
    got = K.batch_cuts(d, ["h"], {"n + 1": "target"}).collect()
    assert {r.id: (r.batch, r.target) for r in got} == {i: (at // 8, 4) for i, at in order.items()}
    assert "1, 8)" in seen[0] and seen[1:] == ["dropped"]


def test_batches_of_tied_short_digests_follow_the_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAD", 1)
    d = spark.range(3000).select("id", F.unhex(F.md5(F.col("id").cast("string"))).alias("h"), (F.col("id") % 37).cast("int").alias("n"))
    rows = sorted(d.collect(), key=lambda r: bytes(r.h))
    want = {r.id: (i // 8, max(x.n for x in rows[i // 8 * 8 : i // 8 * 8 + 8])) for i, r in enumerate(rows)}
    assert {r.id: (r.batch, r.target) for r in K.batch_cuts(d, ["h"], {"n": "target"}).collect()} == want


def test_bans_shuffle_sequences_not_places(spark):
    seqs = spark.createDataFrame([(1, ["a", "b", "a", "c", "a"])], "k int, seq array<string>")
    model = N.ngram_model(seqs, "seq", 1)
    p = plan(N.banned_tokens(seqs, model, "k"))
    generate = p.index("Generate posexplode")
    assert "REPARTITION_BY_COL" in p[generate:]  # below the generator, not above it
    assert "REPARTITION_BY_COL" not in p[:generate]


def test_the_model_derives_each_text_once(spark):
    from taffeta.plans.distributions import taf_seqs
    assert plan(taf_seqs(spark, "/root/testdata/sf0.001")).count("array_join(") == 1


def test_folders_are_written_without_a_sort(spark, tmp_path):
    d = spark.range(100).select(F.col("id").cast("string").alias("prompt"), F.lit("c").alias("completion"), (F.col("id") % 3).cast("string").alias("split"))
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    with open_writers(spark):
        assert spark.conf.get(name) == "32"
    assert spark.conf.get(name) == before
    store.save_dataset(d, str(tmp_path / "s"))
    assert sorted(store.load_dataset(spark, str(tmp_path / "s"), "1").select("prompt").toPandas()["prompt"].astype(int)) == list(range(1, 100, 3))
    jsonl.write_jsonl(d.drop("split"), str(tmp_path / "j"), compression="snappy")
    assert list((tmp_path / "j").glob("*.snappy"))
    assert jsonl.read_jsonl(spark, str(tmp_path / "j"), jsonl.PAIR_SCHEMA).exceptAll(d.drop("split")).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_lines_in_short_runs(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(text, "RUN_BITS", bits)
    for i, body in enumerate(["###\na\n###\n\n###\nb\r\nc\n\n##\n\n#\n#\nd\n###", "x\n###\n", "\n\n#\ry\r\r#\rz"]):
        (tmp_path / f"{i}.txt").write_bytes(body.encode())
    rows = lambda d: sorted(map(tuple, d.select("path", "text").collect()))
    assert rows(text.scan_records_by_line(spark, str(tmp_path), keep_empty=True)) == rows(text.scan_records(spark, str(tmp_path), keep_empty=True))


def test_lines_are_not_shuffled_before_they_are_stored(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a\n###\nb")
    assert "hashpartitioning(path" not in plan(text._lines(spark, str(tmp_path)).select("value", "_end", "_start")).split("BroadcastExchange")[0]


def test_results_by_strategy_leaves_the_pair_schema(spark):
    from taffeta.plans import catalog
    sf = "/root/testdata/sf0.001"
    assert catalog.QUERIES["results_by_strategy"](spark, sf).columns == ["prompt", "completion", "strategy"]
    assert jsonl.PAIR_SCHEMA.names == ["prompt", "completion"]
    assert catalog.QUERIES["jsonl_roundtrip"](spark, sf).columns == ["prompt", "completion"]


def test_arrays_are_written_in_one_pass(spark, tmp_path, monkeypatch):
    def stored(*a):
        raise AssertionError("rows are stored before they are written")

    monkeypatch.setattr(jsonl, "materialise", stored)
    d = spark.createDataFrame([(i, 'a "]" \n') for i in range(7)] + [(None, None)] * 2, "i int, t string").repartition(3)
    jsonl.write_json_arrays(d, str(tmp_path / "a"), 4)
    texts = [p.read_text() for p in (tmp_path / "a").glob("document=*/part-*")]
    assert len(texts) == len(list((tmp_path / "a").glob("document=*")))
    got = [(r.get("i"), r.get("t")) for t in texts for r in json.loads(t)]
    assert sorted(got, key=str) == sorted(map(tuple, d.collect()), key=str)


def test_compressed_arrays_are_neither_stored_nor_shuffled_to_be_read(spark, tmp_path, monkeypatch):
    def stored(*a):
        raise AssertionError("pieces are stored before they are read")

    monkeypatch.setattr(jsonl, "materialise", stored)
    d = spark.createDataFrame([(i, ['{"}', "a\\", ""][i % 3] * (i % 4)) for i in range(40)] + [(None, None)], "i int, t string")
    jsonl.write_json_arrays(d, str(tmp_path / "a"), 3, compression="gzip")
    assert len(list((tmp_path / "a").glob("document=*/part-*.txt.gz"))) == 3
    back = jsonl.read_json_arrays(spark, str(tmp_path / "a"), d.schema)
    assert "Exchange" not in plan(back)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, d.collect()), key=str)


def test_split_and_compressed_arrays_are_read_together(spark, tmp_path):
    import gzip
    rows = [{"k": i, "v": ['}"{', "\\" * 3, "é{", ""][i % 4] * (i % 5)} for i in range(90)]
    (tmp_path / "a.json").write_text(json.dumps(rows[:60]))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(json.dumps(rows[60:], indent=1).encode()))
    names = {"spark.sql.files.maxPartitionBytes": "250", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        got = jsonl.read_json_arrays(spark, str(tmp_path), "k long, v string").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.k, r.v) for r in got) == [(r["k"], r["v"]) for r in rows]
