"""Collocations against brute force."""

import random
import re
from collections import Counter

import pytest

from cases import collect, docs, rows
from taffeta.llm import phrases

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(documents, least, top=2000, longest=5):
    f, n = Counter(), Counter()
    for lang, text in documents:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, p), a in candidates.items():
        if any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    ranked = []
    for lang in sorted({o[0] for o in out}):
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))[:top]
        ranked += [(lang, i + 1, o[3], o[2], o[4], o[5], o[6], o[1]) for i, o in enumerate(mine)]
    return ranked


def run(spark, documents, least, **kw):
    d = spark.createDataFrame(documents, "lang string, text string").repartition(4)
    return sorted(tuple(r.values()) for r in collect(phrases.collocations(spark, d, least, **kw)))


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary, marks = [f"w{i}" for i in range(25)] + ["Été", "ÀB", "x y"], [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ? "]
    out = []
    for i in range(n):
        words = r.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=r.randrange(0, 80))
        if r.random() < 0.4:
            words[3:3] = ["one", "Two", "three", "four", "five", "six"]
        if r.random() < 0.3:
            words += ["again", "and"] * r.randrange(1, 4)
        out.append((r.choice(["a", "a", "b", None, "und"]), "".join(w + r.choice(marks) for w in words)))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("HOT", 60), ("VOCABULARY_BUCKETS", 4), ("BLOCK_BYTES", 2000), ("ENTRIES", 50), ("BUCKET_WORDS", 500)):
            monkeypatch.setattr(phrases, name, value)
    documents = corpus(1, 200)
    want = sorted(brute(documents, 12))
    assert len(want) > 50
    assert run(spark, documents, 12) == want


def test_only_the_best_are_returned_and_two_words_suffice(spark):
    documents = corpus(2, 80)
    assert run(spark, documents, 5, top=7, longest=3) == sorted(brute(documents, 5, 7, 3))


def test_scores_beyond_64_bits(spark):
    values = [(10**16, 10**17, 3 * 10**16, 7 * 10**16), (101, 999999999999, 333, 100)]
    d = spark.createDataFrame(values, "a long, n long, l long, r long").select(phrases.score("a", "n", "l", "r").alias("s"))
    assert [r["s"] for r in collect(d)] == [1000 * a * n // (x * y) for a, n, x, y in values]


def test_odd_rows(spark):
    got = sorted(tuple(r.values()) for r in collect(phrases.collocations(spark, docs(spark), 2)))
    want = sorted(brute([(r[2], r[1]) for r in rows()], 2))
    assert got == want and want
    assert collect(phrases.collocations(spark, docs(spark, empty=True))) == []
