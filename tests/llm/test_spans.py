"""Repeated spans against brute force."""

import hashlib
import random
import re

import pytest

from cases import collect, docs, rows
from taffeta.llm import spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(documents, size):
    """The earlier of equal windows is that of the smaller doc_id, then of the earlier row."""
    seen, out = set(), []
    for i, text in sorted(documents, key=lambda d: (d[0] is None, d[0] or 0)):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - size + 1):
            w = tuple(words[s : s + size])
            if w in seen:
                gone[s : s + size] = [True] * size
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), kept))
    return out


def order(rows_):
    return sorted(rows_, key=lambda x: (x[0] is None, x[0] or 0, *x[1:]))


def run(spark, documents, window=20, anchor=10, parts=5):
    d = spark.createDataFrame(documents, "doc_id long, text string").repartition(parts)
    return order((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in collect(spans.dedup_spans(spark, d, window, anchor)))


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    passages = [r.choices(vocabulary, k=k) for k in (19, 20, 21, 30, 55, 200)]
    out = []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randrange(0, 60))
        for p in r.sample(passages, r.randrange(0, 4)):
            a, b = sorted((r.randrange(0, len(p)), r.randrange(0, len(p) + 1))) if r.random() < 0.5 else (0, len(p))
            at = r.randrange(0, len(words) + 1)
            words[at:at] = p[a:b]
        out.append((i * 3 % n, " ".join(words)))
    out += [(n + i, out[5][1]) for i in range(30)]
    out += [(2 * n, " ".join(["ha"] * 100)), (2 * n + 1, "ha " * 45 + "stop"), (2 * n + 2, " ".join(["x", "y", "z"] * 30))]
    return out


@pytest.mark.parametrize("hot, block", [(5000, 8 << 20), (3, 3000)])
def test_removed_words_equal_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "BLOCK_BYTES", block)
    documents = corpus(2, 301)
    want = order(brute(documents, 20))
    assert sum(w[2] for w in want) > 5000
    assert run(spark, documents) == want


def test_short_windows_and_changed_contexts(spark):
    # the first holder of the middle has another context than the second and third
    documents = [(1, "a b c d e f g h"), (2, "x b c d e y z q"), (3, "r x b c d e y s"), (4, "b c d"), (5, "B c d e")]
    assert run(spark, documents, 4, 2) == order(brute(documents, 4))


def test_a_false_hash_is_not_believed(spark, monkeypatch):
    documents = corpus(3, 40)
    monkeypatch.setattr(spans, "_digests", lambda text, start, n: (start * 0 + hash(text), start))
    texts = {t for _, t in documents}
    got = run(spark, documents)
    copies = [d for d in brute(documents, 20) if d[3] == "" and d[1] >= 20]
    assert sum(g[2] for g in got) <= sum(c[1] for c in copies) and len(texts) < len(documents)


def test_odd_rows(spark):
    got = collect(spans.dedup_spans(spark, docs(spark)))
    mine = sorted((g["n_words"], g["n_removed"], g["kept"]) for g in got)
    assert mine == sorted(b[1:] for b in brute([(r[0], r[1]) for r in rows()], 20))
    digests = collect(spans.dedup_spans(spark, docs(spark), texts=False))
    assert sorted(d["kept_sha256"] for d in digests) == sorted(hashlib.sha256(g["kept"].encode()).hexdigest() for g in got)
    assert collect(spans.dedup_spans(spark, docs(spark, empty=True))) == []
