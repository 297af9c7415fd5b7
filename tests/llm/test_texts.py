"""Fingerprints, MinHash, line de-duplication."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import collect, docs, rows, words
from taffeta.llm import components, fingerprints, hashing, lines, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").encode().lower().decode()


def shingles(t, n):
    w = WORD.findall(lower(t))
    if not w:
        return frozenset()
    return frozenset(zip(*[w[i:] for i in range(n)])) if len(w) >= n else frozenset([tuple(w)])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_shingle_sets_have_the_sizes_of_the_real_ones():
    texts = [r[1] for r in rows()]
    for n in (2, 5):
        assert [len(s) for s in hashing.Words(texts).shingles(n)] == [len(shingles(t, n)) for t in texts]


def test_edited_fingerprints_against_brute_force(spark):
    got = collect(fingerprints.with_edited(spark, docs(spark)))
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for i, r in enumerate(order):
        t, u = r[1] or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        near = [jaccard(shingles(t, 5), shingles(x, 5)) for x in (e, u)]
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), near))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    mine = sorted([(g["doc_id"], g["n_chars"], g["edited_sha256"], [g["near_edited"], g["near_next"]]) for g in got], key=key)
    assert [m[:3] for m in mine] == [w[:3] for w in sorted(want, key=key)]
    for m, w in zip(mine, sorted(want, key=key)):
        assert np.allclose(m[3], w[3], atol=0.17)  # four standard errors of 128 hashes
    same = {}
    for g in got:
        assert same.setdefault((g["doc_id"], g["n_chars"]), g["fingerprint"]) == g["fingerprint"]


def test_fingerprints_of_no_rows_and_of_one(spark):
    assert collect(fingerprints.with_edited(spark, docs(spark, empty=True))) == []
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")
    row = collect(fingerprints.with_edited(spark, one))[0]
    assert row["near_next"] == 1.0 and row["fingerprint"]


def test_merged_sketch_is_the_sketch_of_the_union(spark):
    parts = [(g, " ".join(words(i, 300))) for i, g in enumerate([1, 1, 1, 2])] + [(3, None)]
    df = fingerprints.fingerprint(spark.createDataFrame(parts, "g long, text string"))
    merged = {r["g"]: fingerprints.unpack(r["fingerprint"]) for r in collect(fingerprints.merge(df, ["g"]))}
    for g in (1, 2, 3):
        every = [s for k, t in parts if k == g for s in hashing.Words([t]).shingles(5)]
        assert merged[g].tolist() == np.unique(np.concatenate(every))[: fingerprints.K].tolist()
    a, b = (hashing.Words([" ".join(x)]).shingles(5)[0] for x in (words(1, 900), words(1, 900)[:450]))
    a, b = a[:128], b[:128]
    assert abs(fingerprints.containment(b, a) - 1) < 0.3 and abs(fingerprints.distinct_count(a) - 896) < 350


def brute_components(items, n, percent=80):
    sets = [shingles(t, n) for _, t in items]
    group = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    out = []
    for i in range(len(items)):
        ids = [items[j][0] for j in range(len(items)) if group[j] == group[i] and items[j][0] is not None]
        out.append((items[i][0], len(sets[i]), min(ids, default=None), items[i][0] == min(ids, default=None)))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_brute_force(spark, n):
    items = [(r[0], r[1]) for r in rows()]
    got = [(g["doc_id"], g["n_shingles"], g["component_id"], g["kept"]) for g in collect(minhash.near_duplicates(spark, docs(spark), words=n))]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(brute_components(items, n), key=key)


def test_no_link_is_lost_in_a_large_group(spark, monkeypatch):
    """A chain of near copies in large buckets, cut into several blocks."""
    monkeypatch.setattr(minhash, "FEW", 3)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base, items = words(8, 200), []
    for i in range(60):
        text = list(base)
        text[:3 * i] = words(100 + i // 6, 3 * i)
        items.append((i, " ".join(text)))
    df = spark.createDataFrame(items, "doc_id long, text string")
    got = sorted((g["doc_id"], g["component_id"]) for g in collect(minhash.near_duplicates(spark, df, words=2)))
    assert got == [(a, c) for a, _, c, _ in brute_components(items, 2)]


def _varied(n, seed=8):
    """A base text's copies, each with a few words of its own, some of them linked and some not."""
    base, out = words(seed, 200), []
    for i in range(n):
        text = list(base)
        for j in range(0, 200, 200 // (1 + i % 9)):
            text[j] = f"own{i // 2}x{j}"
        out.append((i, " ".join(text + [str(i % 2)])))
    return out


def test_what_stays_outside_is_sought_without_every_pair_of_blocks(spark, monkeypatch):
    """Members of a large bucket that the star leaves apart are few: rows grow with the members, not their square."""
    monkeypatch.setattr(minhash, "FEW", 3)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    items = _varied(96)
    df = spark.createDataFrame(items, "doc_id long, text string")
    sought = []
    search_blocks = minhash._search_blocks
    monkeypatch.setattr(minhash, "_search_blocks", lambda members, *a: sought.append(members) or search_blocks(members, *a))
    got = sorted((g["doc_id"], g["component_id"]) for g in collect(minhash.near_duplicates(spark, df, words=5)))
    assert got == [(a, c) for a, _, c, _ in brute_components(items, 5)]
    rows = sought[0].selectExpr("count(*) as n", "sum(n_outside + if(outside, n_blocks, 0)) as made", "sum(n_blocks) as square").first()
    assert rows.n == 0 or rows.made < rows.square


def test_sets_of_their_own_are_set_aside(spark):
    members = spark.createDataFrame([(1, n, n) for n in (1, 2, 3)], "bucket long, node long, part long")
    texts = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "a b c d e f x y z w")], "node long, text string")
    assert sorted(r.node for r in minhash._linkable(members, texts, 1, 80).collect()) == [1, 2]


def test_a_block_is_searched_for_those_that_seek():
    sets = [np.arange(10), np.arange(10), np.arange(10), np.arange(20, 30)]
    assert sorted(minhash.search([1, 2, 3, 4], [1, 2, 2, 4], sets, 80, [True, False, False, True])) == [(1, 2)]
    assert minhash.search([1, 2, 3, 4], [1, 2, 2, 4], sets, 80, [False] * 4) == []


def test_near_duplicates_of_an_empty_table(spark):
    assert collect(minhash.near_duplicates(spark, docs(spark, empty=True))) == []


def test_signatures_estimate_the_similarity():
    a, b = (hashing.Words([" ".join(x)]).shingles(2)[0] for x in (words(1, 500), words(1, 500)[:400]))
    equal = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(equal - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301)]
    got = dict((r["node"], r["root"]) for r in collect(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}
    assert collect(components.components(spark.createDataFrame([], "a long, b long"))) == []


def test_shared_passages_stay_in_the_first_document_only(spark):
    got = collect(lines.dedup_lines(spark, docs(spark)))
    assert len(got) == len(rows()) and list(got[0]) == docs(spark).columns
    passage = words(3, 70)
    text = {g["doc_id"]: g["text"] for g in got if g["doc_id"] is not None}
    assert " ".join(passage) in text[11] and not any(w in text[12] for w in [" ".join(passage[i:i + 8]) for i in range(62)])
    assert text[12].startswith("\n".join(words(4, 30))) and text[12].endswith("last line")
    for i in (0, 1, 2, 3, 5, 10, 13, 14, 15, 16):
        assert text[i] == rows()[i][1]
    six = [g["text"] for g in got if g["doc_id"] == 6]
    assert sorted(six) == ["", "", rows()[6][1]] and text[8] == "" and text[9] == ""
    assert collect(lines.dedup_lines(spark, docs(spark, empty=True))) == []


def test_patience_anchors_rise_in_both():
    assert lines.anchors([1, 2, 3, 4, 5, 5], [4, 1, 2, 9, 3, 5]) == [(0, 1), (1, 2), (2, 4)]
    assert lines.anchors([], [1]) == []


def test_buckets_are_joined_without_a_shuffle_of_the_texts(spark):
    from taffeta.llm.numbering import numbered_buckets
    stored = numbered_buckets(docs(spark))
    assert stored.drop("_rid").columns == docs(spark).columns and stored.count() == docs(spark).count()
    assert stored.select("_rid").distinct().count() == stored.count()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = spark.range(5).select(F.col("id").alias("_rid"))
        plan = stored.join(few, "_rid", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert not [t.name for t in spark.catalog.listTables()]
    assert numbered_buckets(docs(spark, empty=True)).count() == 0


def brute_windows(items, n=50):
    """Words of each text without those of windows that an earlier document has."""
    seen, out = set(), []
    for _, text in items:
        w = WORD.findall(text)
        low, mine, gone = [lower(x) for x in w], set(), set()
        for i in range(len(w) - n + 1):
            window = tuple(low[i:i + n])
            mine.add(window)
            if window in seen:
                gone.update(range(i, i + n))
        seen |= mine
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def left_of(spark, texts):
    items = list(enumerate(texts))
    got = collect(lines.dedup_lines(spark, spark.createDataFrame(items, "doc_id long, text string").repartition(3)))
    left = [WORD.findall(g["text"]) for g in sorted(got, key=lambda g: g["doc_id"])]
    assert left == brute_windows(items)
    return left


def test_passages_are_found_behind_a_first_document_with_parts_of_them(spark):
    texts, alone = [], []
    for s in range(40):
        passage = words(1000 + s, 60)
        parts = passage[:28] + ["changed"] + passage[30:]
        around = [words(2000 + 10 * s + i, 40) for i in range(6)]
        texts += [" ".join(a + x + b) for a, x, b in zip(around[::2], (parts, passage, passage), around[1::2])]
        alone.append(around[4] + around[5])
    assert left_of(spark, texts)[2::3] == alone


def test_passages_that_come_twice_or_in_another_order(spark):
    a, b, c = words(31, 70), words(32, 80), words(33, 60)
    around = [words(40 + i, 30) for i in range(12)]
    texts = [a + around[0] + b, around[1] + b + around[2] + a + around[3],  # swapped
             around[4] + c + around[5], c + around[6] + c,  # twice in the later one
             around[7] + a + around[8] + a + around[9] + b + around[10] + b]
    left = left_of(spark, [" ".join(t) for t in texts])
    assert left[1] == around[1] + around[2] + around[3] and left[3] == around[6]
    assert left[4] == around[7] + around[8] + around[9] + around[10]


def test_passages_in_lines_of_any_length(spark):
    texts, alone = [], []
    for s in range(200):
        passage, around = " ".join(words(5000 + s, 50)), [" ".join(words(6000 + 4 * s + i, 40)) for i in range(4)]
        texts += [f"{a} {passage} {b}" for a, b in zip(around[::2], around[1::2])]
        alone.append(WORD.findall(around[2] + " " + around[3]))
    short = words(7, 90)
    texts += ["\n".join(short), " ".join(words(71, 20)) + "\n" + "\n".join(short) + "\n" + " ".join(words(72, 20))]
    alone.append(words(71, 20) + words(72, 20))
    assert left_of(spark, texts)[1::2] == alone


def test_windows_are_compared_in_halves_by_one_number(spark, monkeypatch):
    """A window's row is a place, a mark, a hash and a word; no half of the windows waits for the other's shuffle."""
    stored = {}
    keep = lines.materialise
    monkeypatch.setattr(lines, "materialise", lambda df, name: stored.setdefault(name, []).append(df) or keep(df, name))
    windows = []
    made = lines._window_rows
    monkeypatch.setattr(lines, "_window_rows", lambda *a: windows.append(made(*a)) or windows[-1])
    passage = " ".join(words(3, 60))
    items = [(2, "second " + passage), (None, passage + " null"), (1, "first " + passage), (1, "again " + passage), (None, passage), (3, "other")]
    got = {tuple(g.values()) for g in collect(lines.dedup_lines(spark, spark.createDataFrame(items, "doc_id long, text string").coalesce(1)))}
    assert got == {(2, "second "), (None, "null"), (1, "first " + passage), (1, "again "), (None, ""), (3, "other")}
    assert windows[0].columns == ["place", "mark", "hash", "at"] and len(stored["lines-found"]) == 2
    assert all("SortAggregate" not in d._jdf.queryExecution().executedPlan().toString() for d in stored["lines-heads"])


def test_windows_of_copied_runs_are_not_compared_one_by_one(spark, monkeypatch):
    """A run of windows that an earlier document has goes whole; only different runs of one mark are opened."""
    counted = []
    made = lines._window_rows
    monkeypatch.setattr(lines, "_window_rows", lambda *a: counted.append(made(*a).count()) or made(*a))
    copies = [" ".join(words(90 + i // 3, 300)) for i in range(9)]
    assert left_of(spark, copies)[1::3] == [[]] * 3 and counted == [0]
    twice = words(95, 120)
    near = [[w if (i + 37 * k) % 160 else w + "x" for i, w in enumerate(words(96, 500))] for k in range(5)]
    parts = [words(97, 80) + near[2][100:260], twice + words(98, 20) + twice, words(99, 40) + twice[30:] + near[0][:90]]
    left_of(spark, [*copies[:2], *(" ".join(t) for t in near + parts + near[:2] + parts[::-1])])
    assert 0 < counted[1] < 2500


def test_rows_are_numbered_in_the_order_of_reading(spark):
    from taffeta.llm.numbering import numbered
    stored = numbered(spark.range(0, 500, 1, 7).withColumn("_rid", F.lit(0)))
    assert stored.columns == ["_rid", "id"] and [r.id for r in stored.orderBy("_rid").collect()] == list(range(500))
