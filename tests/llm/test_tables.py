"""Mixing, neighbours, the pipeline, registration."""

import numpy as np
from pyspark.sql import functions as F

from cases import collect, docs, rows
from taffeta.llm import hilbert, mixing, neighbours


def test_targets_fill_by_weight_up_to_the_cap():
    got = mixing.targets([100, 1000, 10, 0])
    assert got[0] == 200 and got[2] == 20 and got[3] == 0 and abs(sum(got) - 1.5 * 1110) < 1e-6 and got[1] <= 2000
    assert mixing.targets([]) == []


def test_flight_keeps_the_sums():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 900, 500).astype(float), np.full(500, 0.37)
    q = mixing.flight(p, size, "x")
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
    same = mixing.flight(np.full(50, 0.5), np.full(50, 7.0), "x")
    assert abs(same.sum() - 25) < 1e-6 and ((same > 0) & (same < 1)).sum() <= 2


def test_mix_of_the_cases(spark):
    got = collect(mixing.copies(mixing.narrow(docs(spark))))
    assert len(got) == len(rows()) and all(g["copies"] in (0, 1, 2) for g in got)
    again = collect(mixing.copies(mixing.narrow(docs(spark).repartition(5))))
    key = lambda g: tuple((v is not None, v or 0) for v in g.values())
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(docs(spark))
    assert mixed.columns == docs(spark).columns and mixed.count() == sum(g["copies"] for g in got)
    assert collect(mixing.copies(mixing.narrow(docs(spark, empty=True)))) == []


def test_mix_comes_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.copies(mixing.narrow(table)).groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    assert all(abs(g["taken"] - g["target"]) <= 0.01 * g["target"] + 5 for g in collect(got))


def test_small_sources_beside_a_large_one_come_near_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rng = np.random.default_rng(5)
    sizes = [("big", int(n)) for n in rng.integers(20, 200, 1500)]
    for i in range(8):
        sizes += [(f"small{i}", int(n)) for n in [*rng.integers(20, 200, 35), 900]]
    table = spark.createDataFrame([(i, s, n, i) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, size long, row long")
    got = collect(mixing.copies(table, weights=(20,) + (1,) * 8, share=0.5))
    assert len(got) == len(sizes)
    taken, target = {}, {}
    for g in got:
        source = sizes[g["doc_id"]][0]
        taken[source], target[source] = taken.get(source, 0) + g["size"] * g["copies"], g["target"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)


def test_hilbert_neighbours_touch():
    grid = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    walk = grid[np.argsort(hilbert.keys(grid, 3))]
    assert np.abs(np.diff(walk, axis=0)).sum(1).max() == 1


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    good[7] = (7, good[100][1])
    good[8] = (8, good[100][1])
    odd = [(400, None), (500, [0.0] * 6), (600, [float("nan")] * 6), (700, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (800, [1.0]), (None, good[0][1])]
    table = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("at", F.lit(1))
    got = collect(neighbours.search(spark, table, F.col("vec_id") % 100 == 0))
    assert sorted({g["query_id"] for g in got}) == [0, 100, 200]
    all_ = good + [odd[-1]]
    for q in (0, 100, 200):
        mine = [(g["vec_id"], g["score"]) for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == q]
        d = sorted((float(np.sqrt(np.square(np.array(v) - good[q][1]).sum())), i is None, i or 0, i) for k, (i, v) in enumerate(all_) if k != q)
        assert mine == [(x[3], x[0]) for x in d[:10]]
    assert collect(neighbours.search(spark, table.limit(0), F.col("vec_id") % 100 == 0)) == []
    assert len(collect(neighbours.search(spark, table.where("vec_id < 3"), F.col("vec_id") % 100 == 0))) == 2


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = neighbours.search(spark, table, F.col("vec_id") % 100 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("n")).collect()
    rows_ = table.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows_]), np.array([r["embedding"] for r in rows_], float)
    hit = 0
    for g in got:
        d = np.sqrt(np.square(x - x[ids == g["query_id"]][0]).sum(1))
        d[ids == g["query_id"]] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & set(g["n"]))
    assert hit / (10 * len(got)) >= 0.9


def test_copies_of_a_vector_are_found_exactly(spark):
    rng = np.random.default_rng(11)
    hot, other = rng.normal(size=16).tolist(), rng.normal(size=16).tolist()
    vectors = [hot if i % 3 == 0 else other if i % 50 == 7 else rng.normal(size=16).tolist() for i in range(3000)]
    made = [*enumerate(vectors), (600, hot), (600, hot), (100, vectors[100]), (None, hot)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for g in collect(neighbours.search(spark, table, F.col("vec_id") % 100 == 0)):
        got.setdefault(g["query_id"], []).append((g["rank"], g["score"], g["vec_id"]))
    x = np.array([v for _, v in made])
    order = np.array([2**62 if i is None else i for i, _ in made])
    hits = {True: [], False: []}
    for at, (i, v) in enumerate(made):
        if i is None or i % 100:
            continue
        d = np.sqrt(np.square(x - np.array(v)).sum(1))
        d[at] = np.inf
        want = [(d[j], made[j][0]) for j in np.lexsort((order, d))[:10]]
        times = sum(j == i for j, _ in made)
        mine = sorted(got[i])
        assert [r for r, _, _ in mine] == sorted([*range(1, 11)] * times)
        mine = [(s, j) for r, s, j in mine][::times]
        hits[v == hot].append(len(set(want) & set(mine)) / 10)
        assert v != hot or mine == want
    assert np.mean(hits[True]) == 1 and np.mean(hits[False]) >= 0.9


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = table
    for name, stage in P.STAGES:
        out = stage(spark, kept, sf)
        if name != "encoding":
            assert out.columns == table.columns
        from taffeta.session import materialise
        kept = materialise(out, "test-stage")
    assert kept.where(~F.col("round_trip")).isEmpty() and kept.count() > 0
    odd = docs(spark)
    for name, stage in P.STAGES[:4]:
        odd = materialise(stage(spark, odd, sf), "test-stage")
        assert odd.columns == docs(spark).columns
    texts = [r["text"] for r in collect(odd)]
    assert not any("1d10t" in (t or "") and texts.count(t) > 2 for t in texts)


def test_registration():
    import __spark_entry__ as E
    names = [n for n in E.queries() if n.startswith("op") or n == "pipeline"]
    assert {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 14)) and "pipeline" in names
