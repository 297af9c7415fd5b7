"""Golden micro-cases (FIXTURES.md section 4), one per operator."""

import math

import pytest
from pyspark.sql import functions as F

from taffeta.functions import taf
from taffeta.functions.text import py_split_ws, py_strip
from taffeta.operators import analysis as A
from taffeta.operators import distributions as N
from taffeta.operators import metadata as M
from taffeta.operators import prefixes as G
from taffeta.operators import scoring as E
from taffeta.operators import strategies as S
from taffeta.operators import tokens as K
from taffeta.operators.segment import segment_records


def one(spark, value, col_expr, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr.alias("r")).first()["r"]


def test_segment_keeps_trailing_empty(spark):
    df = spark.createDataFrame([("a\n###\n\nb\n###\n",)], "value string")
    assert [r.text for r in segment_records(df).orderBy("pos").collect()] == ["a", "b", ""]


def test_segment_strips_and_splits_runs(spark):
    df = spark.createDataFrame([("r one\n###\nr two\nBECMG x\n####\n\nr three\n",)], "value string")
    got = [r.text for r in segment_records(df).orderBy("pos").collect()]
    assert got == ["r one", "r two\nBECMG x", "r three"]


def test_python_whitespace(spark):
    assert one(spark, "  a b \n", py_strip(F.col("t"))) == "a b"
    assert one(spark, "  ", py_split_ws(F.col("t"))) == []
    assert one(spark, " a\tb\n c ", py_split_ws(F.col("t"))) == ["a", "b", "c"]


@pytest.mark.parametrize("text,expected", [
    ("BECMG 1 TEMPO 2", ["BECMG 1", "TEMPO 2"]),
    ("  BECMG 1", ["", "BECMG 1"]),
    ("A\nB BECMG C", ["AB", "BECMG C"]),
])
def test_change_groups(spark, text, expected):
    assert one(spark, text, taf.change_groups(F.col("t"))) == expected


def test_extract_temps(spark):
    df = spark.createDataFrame([(1, "A TX10/1Z TN01/2Z B TX20/1Z TN09/2Z"), (2, "TX10\nTN01")], "id int, text string")
    got = {r.id: (r.tx, r.tn) for r in M.extract_temps(df).collect()}
    assert got == {1: ("TX10", "TN09"), 2: (None, None)}


def test_station_modes(spark):
    p = "TAF [TX22 TN13] AMD KWRI 120435Z 1204/1308 18015G25KT 9999 VCSH SCT012"
    df = spark.createDataFrame([(p,)], "prompt string")
    assert M.extract_station(df, mode="as_is").first().icao == "VCSH"
    assert M.extract_station(df, mode="first").first().icao == "KWRI"


def test_prefix_pairs_micro(spark):
    df = spark.createDataFrame([("TAF [H] a b",), ("one",)], "templated string")
    got = sorted((r.prompt, r.completion) for r in G.prefix_pairs(df).collect())
    assert got == sorted([("<|bos|>TAF ", "[H] a b<|eos|>"), ("<|bos|>TAF [H] ", "a b<|eos|>"),
                          ("<|bos|>TAF [H] a ", "b<|eos|>")])


@pytest.mark.parametrize("kind,text,expected", [
    ("wind", "Z 23015G25KT 9999", "Z 230 15 G 25 KT 9999"),
    ("wind", "23015G25KT", "23015G25KT"),
    ("cloud", "X BKN020CB", "X BKN 020 CB"),
    ("legacy", "TAF KBLV 020600Z 0206/0306 18010G25KT 9999 BKN020CB",
     "TAF KBLV 020 600Z 0206/0306 180 10 G25 KT 9999 BKN 020 CB"),
])
def test_token_splitting(spark, kind, text, expected):
    assert one(spark, text, taf.split_tokens(F.col("t"), kind)) == expected


def test_temperature_numbers(spark):
    df = spark.createDataFrame([("M05",), ("",), (None,)], "t string")
    got = [r.r for r in df.select(A.temperature(F.col("t")).alias("r")).collect()]
    assert got == [-5.0, None, None]


@pytest.mark.parametrize("text,expected", [(" BR OVC006", " BR"), ("BR", ""), ("BR OVC", "BR")])
def test_next_word(spark, text, expected):
    assert one(spark, text, taf.next_word(F.col("t"))) == expected


def test_next_line(spark):
    assert one(spark, " A B\nC", taf.next_line(F.col("t"))) == " A B\n"


def test_all_upper(spark):
    df = spark.createDataFrame([([""],), (["123"],), (["AB1"],), (["AB", "c"],), ([],)], "l array<string>")
    assert [r.r for r in df.select(taf.all_upper(F.col("l")).alias("r")).collect()] == [False, False, True, False, True]


def test_normalise_editor_text(spark):
    got = one(spark, "  A B  \nC   \n   \nD \nE", taf.normalise_editor_text(F.col("t"), upper=False))
    assert got == "A B  \nC\nD \nE"
    assert one(spark, "taf kblv", taf.normalise_editor_text(F.col("t"))) == "TAF KBLV"


def test_std_single_row_is_null(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("B", 3.0)], "strategy string, delta double")
    got = {r.strategy: r.std_delta for r in A.std_by(df).collect()}
    assert got["A"] is None and math.isclose(got["B"], math.sqrt(2))


def test_histogram_density(spark):
    df = spark.createDataFrame([("g", v) for v in (0.0, 0.0, 1.0, 3.0)] + [("h", 2.0), ("h", 2.0)], "g string, v double")
    h = {(r.g, r.bin): r for r in A.histogram(df, "g", "v", 3).collect()}
    assert [h[("g", b)]["count"] for b in range(3)] == [2, 1, 1]
    assert [round(h[("g", b)].density, 6) for b in range(3)] == [0.5, 0.25, 0.25]
    assert [h[("h", b)]["count"] for b in range(3)] == [0, 2, 0]
    assert h[("h", 0)].bin_lo == 1.5 and h[("h", 2)].bin_hi == 2.5


def test_top_p_keeps_prefix(spark):
    m = spark.createDataFrame([("c", "a", 5, 10, .5), ("c", "b", 3, 10, .3), ("c", "d", 2, 10, .2)],
                              "context string, token string, count long, total long, p double")
    got = sorted(r.token for r in N.top_p_filter(m, 0.6).collect())
    assert got == ["a", "b"]


def test_top_k_and_greedy(spark):
    m = spark.createDataFrame([("c", "a", 5, 10, .5), ("c", "b", 3, 10, .3), ("c", "d", 2, 10, .2)],
                              "context string, token string, count long, total long, p double")
    k = {r.token: r.p for r in N.top_k_filter(m, 2).collect()}
    assert set(k) == {"a", "b"} and math.isclose(k["a"], 5 / 8)
    assert N.greedy_next(m).first().token == "a"


def test_pad_left(spark):
    df = spark.createDataFrame([([1, 2],)], "ids array<bigint>")
    assert one(spark, None, K.pad_to(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), F.lit(5))) == [0, 0, 0, 1, 2]
    assert df.select(K.mask_for(F.col("ids"), F.lit(5)).alias("m")).first().m == [0, 0, 0, 1, 1]


def test_score_rules(spark):
    rows = [("TAF [TX1 TN0] KX -TSRA", ["TAF [TX1 TN0] KX -TSRA BKN020CB", "BECMG X"]),
            ("TAF [TX1 TN0] KX 9999", ["TAF [TX1 TN0] KX 9999 BKN020"]),
            ("TAF KX -TSRA", ["TAF KX -TSRA bkn020", "BECMG X"]),
            ("TAF KX -TSRA", ["OTHER"])]
    df = spark.createDataFrame(rows, "prompt_text string, generated_text array<string>")
    v = [(r.score, r.score_error) for r in E.score(df).collect()]
    assert v == [(2.0, None), (0.0, None), (-2.0, None), (None, "no_line")]
    p = [r.score for r in E.score(df, variant="penalty").collect()]
    assert p == [2.0, 0.0, -6.0, None]


def test_strategy_catalog(spark):
    cat = S.strategy_catalog(spark)
    assert cat.count() == 29 and len(S.CANONICAL) == 22
    assert cat.where("name = 'TOP_K50_T125'").first().canonical == "TEMP_125"
    assert cat.where("name = 'TOP_KP'").first().canonical == "TOP_P92"


def test_no_repeat_ngram_bans(spark):
    seqs = spark.createDataFrame([(1, ["a", "b", "a"])], "k int, seq array<string>")
    cand = spark.createDataFrame([(1, "b", 3), (1, "c", 1)], "k int, token string, count long")
    got = {r.token: r.p for r in N.no_repeat_ngram(cand, seqs, "k").collect()}
    assert got == {"c": 1.0}


def test_missing_input_raises(spark):
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        spark.read.parquet("/nonexistent/taffeta/input").count()


def _bans(spark, size):
    seqs = spark.createDataFrame([(1, "a b a c a b".split()), (2, "x y".split()), (3, []), (4, "a a a".split()), (5, "a b a b".split())], "k long, seq array<string>")
    model = N.ngram_model(seqs, "seq", size - 1)
    return seqs, model, N.banned_tokens(seqs, model, "k", size=size)


def test_bans_at_every_place_against_a_loop(spark):
    for size in (2, 3):
        seqs, model, bans = _bans(spark, size)
        counts = {(r.context, r.token): (r["count"], r.total) for r in model.collect()}
        want = []
        for r in seqs.collect():
            for end in range(size - 1, len(r.seq) + 1):
                context, gone = r.seq[end - size + 1 : end], []
                for i in range(size - 1, end):
                    if r.seq[i - size + 1 : i] == context and r.seq[i] not in gone:
                        gone.append(r.seq[i])
                if gone:
                    c = " ".join(context)
                    left = counts[c, gone[0]][1] - sum(counts[c, g][0] for g in gone)
                    want.append((r.k, c, end, sorted(gone), left))
        held = bans.collect()
        got = []
        for k, c, end, _, _ in want:
            here = [b for b in held if (b.k, b.context) == (k, c) and b.banned_after < end]
            got.append((k, c, end, sorted(b.token for b in here), min(b.remaining for b in here)))
        assert want and got == want
        assert {(b.k, b.context, b.token) for b in held} == {(k, c, g) for k, c, _, gone, _ in want for g in gone}


def test_distributions_where_tokens_are_banned(spark):
    _, model, bans = _bans(spark, 2)
    at = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "y", 2), (4, "a", 3)], "k long, context string, place int")
    got = {(r.k, r.context, r.token): r.p for r in N.allowed_next(model, bans, at, "k").collect()}
    # after "a": b four times, c once, a twice
    assert got == {(1, "a", "a"): 1.0, (4, "a", "b"): 0.8, (4, "a", "c"): 0.2}


def test_heavy_keys_join_like_others(spark):
    from taffeta.operators.joins import heavy_join
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(300, None, 1)], "i long, w string, v long")
    table = rows.where("w != 'k3'").groupBy("w").count().where("w is not null")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(table, ["w"], how).select("i", "count").collect()))
        assert sorted(map(tuple, heavy_join(rows, table, ["w"], how=how, heavy=5, small=False).select("i", "count").collect())) == want


ASKED = [  # (user, second, typed, completion, asks)
    ("u", 1, "AB", "AB x y", True), ("u", 2, "AB x", "other", False), ("u", 3, "AB x y", "third", False),
    ("u", 4, "AB z", "AB z q", True), ("u", 7300, "AB z q", "later", False), ("u", 7301, "C", "", True), ("u", 7302, "C", "C d", True),
    (None, 1, None, None, True), (None, 2, "", "k", True), (None, 9000, "", "n", False)]


def test_ask_again_depends_on_what_is_shown(spark):
    from taffeta.operators.sessions import changed_prefix
    rows = [(u, s, t, c, i) for i, (u, s, t, c, _) in enumerate(ASKED)]
    d = spark.createDataFrame(rows, "user string, s int, typed string, completion string, id int")
    d = d.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)")).repartition(3)
    got = {r.id: r.request for r in changed_prefix(d, "user", "ts", "id", "typed", "completion").collect()}
    assert [got[i] for i in range(len(ASKED))] == [a[4] for a in ASKED]


def test_ask_again_in_buckets_equals_one_run_over_all_events(spark):
    import random
    from taffeta.operators.sessions import asks, changed_prefix
    r = random.Random(4)
    words = ["a", "b", "aa", "ab", ""]
    rows = [(r.randrange(3), i, "".join(r.choices(words, k=r.randrange(4))), "".join(r.choices(words, k=r.randrange(5)))) for i in range(900)]
    d = spark.createDataFrame(rows, "user int, id int, typed string, completion string")
    d = d.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)")).repartition(4)
    shown, want = {}, {}
    for user, i, typed, completion in rows:
        want[i] = asks(shown.get(user), typed)
        if want[i]:
            shown[user] = completion
    got = {x.id: x.request for x in changed_prefix(d, "user", "ts", "id", "typed", "completion", bucket_us=7_000_000).collect()}
    assert got == want and 0 < sum(want.values()) < 900


def test_order_statistics_of_any_values(spark, monkeypatch):
    import random
    from taffeta.operators import quantiles as Q
    r = random.Random(9)
    monkeypatch.setattr(Q, "FEW", 20)
    monkeypatch.setattr(Q, "ACCURACY", 50)
    n = 3000
    rows = [(r.random() * 10 ** r.randrange(-3, 6), float(r.choice([1, 1, 1, 1, 2, 7])), r.gauss(0, 1) if i % 3 else 0.25, None) for i in range(n)]
    d = spark.createDataFrame(rows, "a double, b double, c double, e double").repartition(5).cache()
    counts = {"a": n, "b": n, "c": n, "e": 0}
    want = {c: sorted(x[i] for x in rows) for i, c in enumerate("abc")}
    ranks = [0, 1, 749, 750, 1499, 2250, n - 2, n - 1]
    got = Q.order_statistics(d, counts, {c: ranks for c in "abc"})
    assert got == {(c, k): want[c][k] for c in "abc" for k in ranks}
    assert Q.quantiles(d, counts, [0.25, 0.5])["e"] == [None, None]
    assert Q.quantiles(d, counts, [0.5])["a"][0] == pytest.approx((want["a"][1499] + want["a"][1500]) / 2)
