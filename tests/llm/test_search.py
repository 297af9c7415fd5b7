"""Ranked search against exhaustive scoring."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from cases import collect, docs, rows
from taffeta.llm import search


def exhaustive(documents, items, k=10):
    held = [(i, Counter(search.terms_of(t))) for i, t in documents]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in search.terms_of(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return out


def ranked(spark, documents, items):
    d = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in collect(search.search(spark, d, q)))


def test_ranks_equal_an_exhaustive_scoring(spark, monkeypatch):
    r = random.Random(5)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    documents = [(i, " ".join(r.choices(common, k=r.randrange(1, 60)) + r.sample(rare, r.randrange(0, 6)))) for i in range(1500)]
    documents += [(2000 + i, documents[7][1]) for i in range(40)]  # ties
    items = [(q, " ".join(r.choices(common, k=4) + r.choices(rare, k=5))) for q in range(20)] + [(50, "W1 w1 W1, w2"), (51, "nowhere"), (52, None)]
    assert ranked(spark, documents, items) == sorted(exhaustive(documents, items))


def test_small_shards_and_blocks_skip_lists_and_lose_nothing():
    r = random.Random(6)
    common = [f"w{i}" for i in range(10)]
    texts = [" ".join(r.choices(common, k=r.randrange(1, 40)) + [f"r{r.randrange(60)}"]) for _ in range(900)]
    documents = list(enumerate(texts))
    n_terms = sum(len(search.terms_of(t)) for t in texts)
    norms, lists = (b.to_pylist() for b in search._shard_rows(0, list(range(900)), texts))
    df = {row["term"]: row["n_docs"] for row in lists}
    read = 0
    for item in ("w1 w2 r3 r4", "r5 r5 w0", "w3 w4 w5"):
        shard = search.Shard(norms[0], 900, n_terms)
        for row in lists:
            shard.add(row)
        (query,) = search._weights([search.terms_of(item)], df, 900)
        want = exhaustive(documents, [(0, item)])
        found, scores = shard.rank(query, want[-1][3])
        got = sorted(zip((-scores).tolist(), found.tolist()))[:10]
        assert [(i, -s) for s, i in got] == [(w[2], w[3]) for w in want]
        read += sum(b >= 0 for _, b in shard.opened) < sum(len(shard.lists[t]["at"]) for t, _ in query)
    assert read  # some blocks stayed compressed


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40], np.int64)
    raw, at = search.pack(values)
    assert search.unpack(raw).tolist() == values.tolist() and at[-1] == len(raw)


def test_odd_rows(spark):
    items = [(1, "quick brown fox licensed"), (1, "quick brown fox licensed"), (None, "über"), (3, ""), (4, "漢字 one two")]
    mine = collect(search.search(spark, docs(spark), spark.createDataFrame(items, "item_id long, text string")))
    want = exhaustive([(r[0], r[1]) for r in rows()], items)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(m["item_id"], m["rank"], m["doc_id"], m["score"]) for m in mine], key=key) == sorted(want, key=key)
    none = spark.createDataFrame([], "item_id long, text string")
    assert collect(search.search(spark, docs(spark), none)) == []
    assert collect(search.search(spark, docs(spark, empty=True), spark.createDataFrame(items, "item_id long, text string"))) == []


@pytest.mark.parametrize("chars", [40])
def test_queries_in_blocks(spark, monkeypatch, chars):
    monkeypatch.setattr(search, "QUERY_CHARS", chars)
    documents = [(i, f"alpha b{i % 7} c{i % 3}") for i in range(100)]
    items = [(q, f"b{q} c{q % 3} alpha") for q in range(7)]
    assert ranked(spark, documents, items) == sorted(exhaustive(documents, items))
