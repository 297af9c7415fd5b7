"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored text.

Words written with look-alike signs (``1d!ot``), drawn-out letters (``idiooot``) or single spaced or
dotted letters (``i d i o t``) become character lattices. A Viterbi search takes the likeliest path
under a trigram character model counted over the whole corpus. The restored text is scored by a
logistic regression on hashed words and word beginnings.

The language model is a grouped count, a fixed number of character classes cubed. The classifier
is fitted on at most about ``TRAIN_DOCS`` labelled rows of each label (a hash of the id picks them), and
holds at most ``FEATURES`` weights; both bound what is broadcast and what the driver sees.

Defined cases: a null text counts as empty and gets the score of a text without features. Without
labelled rows of both labels every score is the smoothed share of label 1. Rows are kept as they
come. Only the text is an input of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taffeta.llm.batches import lean
from taffeta.llm.hashing import ALNUM, LOWER, Words, blocks, mix
from taffeta.session import materialise

TRAIN_DOCS, FEATURES = 4000, 20_000
#: Bytes of word beginnings that are features, besides the whole word.
BEGINNINGS = (4, 5, 6)

# Character classes: a-z, white space and signs, non-ASCII letters' bytes.
_CLASSES, _EDGE = 28, 26
_CLASS = np.full(256, _EDGE, np.int32)
for _c in range(26):
    _CLASS[65 + _c] = _CLASS[97 + _c] = _c
_CLASS[128:] = 27

#: Letters that a sign may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
_SIGN, _LETTER, _DIGIT, _DOT = (np.zeros(256, bool) for _ in range(4))
_SIGN[[ord(c) for c in LOOKS_LIKE]] = True
_LETTER[97:123] = True
_DIGIT[48:58] = True
_DOT[[ord(c) for c in ".-_*'~"]] = True


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all character-class trigrams of all texts."""
    size = _CLASSES ** 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts):
                raw = " ".join([t or "" for t in texts[a:b]]).encode("utf-8", "surrogatepass")
                c = _CLASS[np.frombuffer(b"  " + raw + b"  ", np.uint8)]
                total += np.bincount(c[:-2] * (_CLASSES * _CLASSES) + c[1:-1] * _CLASSES + c[2:], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(size, np.int64)
    for code, n in docs.select(text).mapInArrow(lean(run), "code int, n long").groupBy("code").agg(F.sum("n")).collect():
        out[code] = n
    return out


class CharacterModel:
    """Log probabilities of a class after two others, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray, strength: float = 5.0):
        three = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(float)
        two, one = three.sum(0), three.sum((0, 1)) + 1
        one /= one.sum()
        two = (two + strength * one) / (two.sum(1, keepdims=True) + strength)
        three = (three + strength * two) / (three.sum(2, keepdims=True) + strength)
        self.log = np.log(three).tolist()
        self.known: dict[str, str] = {}

    def restore(self, span: str) -> str:
        """The likeliest reading of a suspicious span; remembered."""
        out = self.known.get(span)
        if out is None:
            if len(self.known) > 200_000:
                self.known.clear()
            out = self.known[span] = self._viterbi(span)
        return out

    def _lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """For each stretch of equal characters the readings and their channel log probabilities."""
        low, steps, i = span.lower(), [], 0
        if len(low) != len(span):
            low = span
        parted = sum(1 for c in low[1::2] if c in " .-_*'~") >= max(2, len(low) // 2 - 1)
        while i < len(low):
            c, j = low[i], i + 1
            while j < len(low) and low[j] == c:
                j += 1
            n = j - i
            if c.isalpha():
                options = [(c * n, 0.0 if n < 3 else -1.5 * n)]
                if n > 1:
                    options.append((c, -4.5 if n == 2 else -0.5))
                if n > 2:
                    options.append((c * 2, -1.0))
            elif parted and c in " .-_*'~":
                options = [("", -0.3 * n), (c * n, -2.0)]
            elif c in "!|+(*" and j == len(low):
                options = [(c * n, 0.0)]  # a closing sign
            elif c in LOOKS_LIKE:
                options = [(c * n, -8.0 if j < len(low) else -4.0)] + [(x * m, -1.0 - 0.5 * (m != n)) for x in LOOKS_LIKE[c] for m in {1, min(n, 2)}]
            else:
                options = [(c * n, 0.0)]
            steps.append(options)
            i = j
        return steps

    def _viterbi(self, span: str) -> str:
        best = {(_EDGE, _EDGE): (0.0, ())}
        for options in [*self._lattice(span), [(" ", 0.0)]]:
            reached: dict = {}
            for (a, b), (cost, path) in best.items():
                for text, price in options:
                    x, y, total = a, b, cost + price
                    for ch in text:
                        z = ord(ch) - 97 if "a" <= ch <= "z" else (27 if ch >= "\x80" else _EDGE)
                        total += self.log[x][y][z]
                        x, y = y, z
                    if (x, y) not in reached or total > reached[x, y][0]:
                        reached[x, y] = (total, (path, text))
            best = reached
        parts, path = [], max(best.values(), key=lambda v: v[0])[1]
        while path:
            path, text = path
            parts.append(text)
        return "".join(parts[::-1])[:-1]


def suspicious(words: Words) -> list[tuple[int, int]]:
    """Byte ranges of spans that may be disguised, in order and apart: words with a sign next to a
    letter, with three equal letters, with parted letters, and rows of four or more one-character words."""
    low = LOWER[words.data]
    letter, sign, dot = _LETTER[low], _SIGN[low], _DOT[low]
    hit = np.zeros(len(low), bool)
    hit[:-1] = (sign[:-1] & letter[1:]) | (letter[:-1] & (_DIGIT | (np.arange(256) == 36) | (np.arange(256) == 64))[low[1:]])
    hit[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
    hit[:-4] |= letter[:-4] & dot[1:-3] & (letter | sign)[2:-2] & dot[3:-1] & (letter | sign)[4:]
    n = len(words.starts)
    if not n:
        return []
    chosen = np.zeros(n, bool)
    chosen[np.maximum(np.searchsorted(words.starts, np.flatnonzero(hit), side="right") - 1, 0)] = True
    tiny = (words.ends - words.starts == 1) & (letter | sign)[words.starts]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tiny.astype(np.int8), [0]])))
    spans = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        cuts = [a, *words.first[(words.first > a) & (words.first < b)].tolist(), b]
        for x, y in zip(cuts, cuts[1:]):
            if y - x >= 4:
                spans.append((int(words.starts[x]), int(words.ends[y - 1])))
                chosen[x:y] = False
    spans += [(int(words.starts[i]), int(words.ends[i])) for i in np.flatnonzero(chosen).tolist()]
    return sorted(spans)


def restore_texts(texts: list[str | None], model: CharacterModel) -> list[str]:
    """The texts with suspicious spans replaced by their likeliest readings."""
    words = Words(texts)
    out = [t or "" for t in texts]
    changed: dict[int, list] = {}
    spans = suspicious(words)
    owner = np.searchsorted(words.at, [s for s, _ in spans], side="right") - 1 if spans else []
    for (s, e), t in zip(spans, owner):
        raw = words.data[s:e].tobytes().decode("utf-8", "surrogatepass")
        new = model.restore(raw)
        if new != raw:
            changed.setdefault(int(t), []).append((s, e, new))
    for t, edits in changed.items():
        at, parts = int(words.at[t]), []
        for s, e, new in edits:
            parts += [words.data[at:s].tobytes(), new.encode("utf-8", "surrogatepass")]
            at = e
        parts.append(words.data[at : int(words.at[t + 1]) - 1].tobytes())
        out[t] = b"".join(parts).decode("utf-8", "surrogatepass")
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit feature) of each word and long enough word beginning, with repeats."""
    words = Words(texts, ALNUM)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    size = words.ends - words.starts
    keys, owners = [words.hashes], [owner]
    for n in BEGINNINGS:
        long = size > n
        keys.append(mix(words.span(words.starts[long], words.starts[long] + n) + np.uint64(n)))
        owners.append(owner[long])
    return np.concatenate(owners), np.concatenate(keys)


def _distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], key[new]


@dataclass
class Model:
    """Sorted features, their weights, and the intercept."""

    characters: CharacterModel
    intercept: float
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text index, index of the feature) of the model's features that the texts have, each once."""
        owner, key = features(texts)
        near = self.maybe[(key & np.uint64((1 << 20) - 1)).astype(np.int64)]
        owner, key = owner[near], key[near]
        at = np.searchsorted(self.keys, key)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == key[ok]
        return _distinct(owner[ok], at[ok])

    def scores(self, texts: list[str]) -> np.ndarray:
        owner, at = self.found(texts)
        z = self.intercept + np.bincount(owner, self.weights[at], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(owner: np.ndarray, at: np.ndarray, label: np.ndarray, n_features: int, l2: float = 0.02, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression of presence features; both labels weigh alike. Gradient steps with momentum."""
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    w, b, vw, vb = np.zeros(n_features), 0.0, np.zeros(n_features), 0.0
    rate = 2.0
    for _ in range(steps):
        z = b + np.bincount(owner, w[at], minlength=len(label))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
        gw = np.bincount(at, g[owner], minlength=n_features) + l2 * w / len(label)
        vw, vb = 0.9 * vw - rate * gw, 0.9 * vb - rate * 0.05 * g.sum()
        w, b = w + vw, b + vb
    return b, w


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """The model from rows whose crc32 of the id leaves a remainder by 5."""
    characters = CharacterModel(trigram_counts(docs, text))
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 2)
        return Model(characters, math.log(share / (1 - share)))
    least = min(TRAIN_DOCS, counts[0], counts[1])
    take = F.when(F.col("toxic") == 1, min(1.0, TRAIN_DOCS / counts[1])).otherwise(min(1.0, max(TRAIN_DOCS, least) / counts[0]))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < take * 1_000_003)
    sample = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(restore_texts(texts[a:b], characters)), batch.column(1).slice(a, b - a).cast(pa.int32())], names=["text", "toxic"])

    sample = materialise(sample.mapInArrow(lean(restored), "text string, toxic int"), "toxic-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in blocks(texts, 8 << 20):
                owner, key = _distinct(*features(texts[a:b]))
                key, back = np.unique(key, return_inverse=True)
                ones = np.bincount(back, toxic[a:b][owner], minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ones), pa.array(np.bincount(back, minlength=len(key)) - ones)], names=["key", "p", "q"])

    n = {t: c for t, c in sample.groupBy("toxic").count().collect()}
    p, q = (F.col(c) for c in ("p", "q"))
    n1, n0 = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    share = (p + q) / (n1 + n0)
    z = (p / n1 - q / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    best = (sample.mapInArrow(lean(counted), "key long, p long, q long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
            .where(p + q >= 4).withColumn("z", F.abs(z)).where("z >= 4").orderBy(F.desc("z"), "key").limit(FEATURES))
    keys = np.sort(np.array([r[0] for r in best.select("key").collect()], np.int64).view(np.uint64))
    model = Model(characters, 0.0, keys, np.zeros(len(keys)))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts):
                owner, at = model.found(texts[a:b])
                parts = np.split(at, np.searchsorted(owner, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(parts, pa.list_(pa.int32()))], names=["toxic", "at"])

    rows = sample.mapInArrow(lean(chosen), "toxic int, at array<int>").collect()  # at most the sample's rows
    rows.sort(key=lambda r: (r[0], r[1]))
    label = np.array([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.array([i for r in rows for i in r[1]], np.int64)
    intercept, weights = fit(owner, at, label, len(keys)) if len(keys) else (-1.0, np.zeros(0))
    return Model(characters, intercept, keys, weights)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", restored: str | None = "restored") -> DataFrame:
    """Adds the score of each text and, unless its name is None, the restored text."""
    df = df.drop(out, *([restored] if restored else []))
    added = [T.StructField(out, T.DoubleType())] + ([T.StructField(restored, T.StringType())] if restored else [])
    schema, at = T.StructType([*df.schema.fields, *added]), df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES weights and a fixed table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in blocks(texts):
                clear = restore_texts(texts[a:b], m.characters)
                columns = [*batch.slice(a, b - a).columns, pa.array(m.scores(clear))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(clear, pa.string())] if restored else []), names=schema.names)

    return df.mapInArrow(lean(run), schema)
