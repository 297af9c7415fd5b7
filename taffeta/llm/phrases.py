"""Phrase collocations by stripes.

A stripe belongs to a prefix of words and counts the words that follow it. Tasks emit the stripes of
their blocks of text, those of a bucket of prefixes as one row; the rows of a bucket are merged
elementwise. A merged stripe gives the counts of the prefix's extensions, which are the totals of the
prefixes one word longer, and its largest count tells whether an extension is as frequent as the
prefix, which subsumes it.

Stripes are built level by level, from the empty prefix (whose stripe is the vocabulary) to prefixes of
one word less than the longest phrase. A phrase as frequent as ``least`` has only such parts, so a
level looks at places where both parts of a phrase passed the level before. What passed is folded
into a table of bits of fixed size (``sieve``), which saves work and decides nothing.

There is a bucket for each ``BUCKET_WORDS`` words of the corpus, so a bucket stays as large as it is when
the corpus grows. The stripe of a prefix of ``HOT`` places or more, and the vocabulary, is spread over
all buckets by the hash of the following word. A merging task holds one bucket.

Scores are exact: products are decimals of 38 digits, which a, n up to 10**17 fit.

Defined cases: a null lang counts as ``und``, together with rows that say so; a null or empty text has no
words; repeated rows count each; ties go by count, then by the phrase's bytes; an empty table gives
no rows. Only the text and the language are read: extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from taffeta.llm import sieve, vocab
from taffeta.llm.hashing import Words, mix
from taffeta.session import materialise

LEAST = 100
LONGEST = 5
TOP = 2000
HOT = 100_000
#: Buckets of the vocabulary, and words of the corpus for each bucket of longer prefixes.
VOCABULARY_BUCKETS = 256
BUCKET_WORDS = 1 << 18
BLOCK_BYTES = 8 << 20
#: Entries of stripes that are merged at once.
ENTRIES = 200_000

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD_BYTES = ~_BREAKS
_WORD_BYTES[[32, 9]] = False

STRIPES = "lang string, bucket int, prefixes string, sizes array<int>, next string, counts array<long>"
MERGED = "lang string, prefix string, next array<string>, counts array<long>, total long, top long"
_KEY = ["lang", "bucket"]
_STRIPES = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("prefixes", pa.string()),
                      ("sizes", pa.list_(pa.int32())), ("next", pa.string()), ("counts", pa.list_(pa.int64()))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list]]:
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            langs.append(lang)
            texts.append(text)
            size += len(text) if text else 0
            if size > BLOCK_BYTES:
                yield langs, texts
                langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def _lists(values: pa.Array, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)


def _rows(keys: list[pa.Array], row: np.ndarray, prefix: np.ndarray, prefixes: pa.Array, following: np.ndarray, words: pa.Array,
          counts: np.ndarray) -> pa.RecordBatch:
    """Entries, sorted by row and then by prefix, as stripes; ``keys`` has an item for each row."""
    runs = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(prefix, prepend=-1) != 0))
    cuts, run_cuts = (np.searchsorted(x, np.arange(len(keys[0]) + 1)) for x in (row, row[runs]))
    sizes = np.diff(np.append(runs, len(row))).astype(np.int32)
    return pa.RecordBatch.from_arrays([
        *(k.cast(f.type) for k, f in zip(keys, _STRIPES)),
        pc.binary_join(_lists(prefixes.take(pa.array(prefix[runs])), run_cuts), "\n"), _lists(pa.array(sizes), run_cuts),
        pc.binary_join(_lists(words.take(pa.array(following)), cuts), " "), _lists(pa.array(counts.astype(np.int64)), cuts)], schema=_STRIPES)


def _block_stripes(langs: list[str], texts: list, level: int, buckets: int, frequent, hot) -> pa.RecordBatch | None:
    words = Words(texts, _WORD_BYTES)
    codes, distinct = vocab.coded(words)
    m, v = len(codes), len(distinct)
    if m <= level:
        return None
    distinct = distinct.cast(pa.string())
    hashes = vocab.hashes(distinct)
    names, lang_of = np.unique(np.array(langs, object), return_inverse=True)
    doc = vocab.doc_of(words)
    lang = lang_of[doc]
    if level:
        piece = np.searchsorted(np.flatnonzero(_BREAKS[words.data]), words.starts) + doc
        at = np.flatnonzero(piece[: m - level + 1] == piece[level - 1 :])
        hashed = np.array([xxhash.xxh3_64_intdigest(x) for x in names], np.uint64)[lang[at]]
        for j in range(level):
            hashed = vocab.follow(hashed, hashes[codes[at + j]])
        use = sieve.passes(frequent, hashed)
        at, hashed = at[use], hashed[use]
        begins = np.zeros(m + 1, bool)
        begins[at] = True
        after = np.minimum(at + level, m - 1)
        use = np.flatnonzero((at + level < m) & (piece[after] == piece[at]) & begins[at + 1])
        at, hashed = at[use], hashed[use]
        if not len(at):
            return None
    else:
        at, hashed = np.arange(m), np.zeros(m, np.uint64)
    prefix = lang[at]
    for j in range(level):
        prefix = prefix * v + codes[at + j]
        if j:
            _, prefix = np.unique(prefix, return_inverse=True)
    _, place, prefix = np.unique(prefix, return_index=True, return_inverse=True)
    entries, counts = np.unique(prefix * v + codes[at + level], return_counts=True)
    prefix, following = np.divmod(entries, v)
    start, hashed = at[place], hashed[place]
    following_hash = hashes[following]
    if level:
        spread = sieve.passes(hot, hashed)[prefix]
        bucket = mix(np.where(spread, vocab.follow(hashed[prefix], following_hash), hashed[prefix])) % np.uint64(buckets)
        prefixes = pc.binary_join_element_wise(*[distinct.take(pa.array(codes[start + j])) for j in range(level)], " ")
    else:
        bucket, prefixes = following_hash % np.uint64(VOCABULARY_BUCKETS), pa.array([""] * len(place))
    key = (lang[start][prefix], bucket.astype(np.int64))
    order = np.lexsort((prefix, *key[::-1]))
    key = [k[order] for k in key]
    begins = np.flatnonzero(reduce(np.logical_or, [np.diff(k, prepend=-1) != 0 for k in key]))
    row = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    keys = [pa.array(names[key[0][begins]], pa.string()), pa.array(key[1][begins])]
    return _rows(keys, row, prefix[order], prefixes, following[order], distinct, counts[order])


def stripes(docs: DataFrame, level: int, buckets: int = 1, frequent=None, hot=None) -> DataFrame:
    """The stripes of prefixes of ``level`` words in blocks of ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _blocks(batches):
            out = _block_stripes(langs, texts, level, buckets, frequent, hot)
            if out is not None:
                yield out

    return docs.mapInArrow(run, STRIPES)


class _Merged:
    """Rows of stripes, sorted by key, merged word by word: the sums of the rows of each key."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        keys = [rows.column(c).combine_chunks() for c in _KEY]
        new = np.ones(len(rows), bool)
        new[1:] = reduce(np.logical_or, [pc.not_equal(k.slice(1), k.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False) for k in keys])
        group = np.cumsum(new) - 1
        self.keys = [k.take(pa.array(np.flatnonzero(new))) for k in keys]
        of_row = pc.list_value_length(rows.column("sizes")).to_numpy()
        sizes = pc.list_flatten(rows.column("sizes")).to_numpy()
        named, self.prefixes = self._coded(pc.split_pattern(rows.column("prefixes"), "\n"))
        code, self.words = self._coded(pc.split_pattern(rows.column("next"), " "))
        runs, run = np.unique(np.repeat(group, of_row) * len(self.prefixes) + named, return_inverse=True)
        entries, entry = np.unique(np.repeat(run, sizes) * len(self.words) + code, return_inverse=True)
        self.counts = np.zeros(len(entries), np.int64)
        np.add.at(self.counts, entry, pc.list_flatten(rows.column("counts")).to_numpy())
        run, self.word = np.divmod(entries, len(self.words))
        self.group, self.prefix = np.divmod(runs[run], len(self.prefixes))

    @staticmethod
    def _coded(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        table = pc.list_flatten(lists).combine_chunks().dictionary_encode()
        return table.indices.to_numpy(zero_copy_only=False).astype(np.int64), table.dictionary

    def last(self) -> pa.RecordBatch:
        """The last key's stripes, as a row that can be merged again."""
        at = np.flatnonzero(self.group == len(self.keys[0]) - 1)
        return _rows([k.slice(len(k) - 1) for k in self.keys], np.zeros(len(at), np.int64), self.prefix[at], self.prefixes,
                     self.word[at], self.words, self.counts[at])

    def finished(self, all_of_them: bool, least: int) -> Iterator[pa.RecordBatch]:
        """The stripes of all keys, or of all but the last."""
        n = len(self.group) if all_of_them else int(np.searchsorted(self.group, len(self.keys[0]) - 1))
        if not n:
            return
        group, prefix, counts = self.group[:n], self.prefix[:n], self.counts[:n]
        begins = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(prefix, prepend=-1) != 0))
        row = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
        keep = np.flatnonzero(counts >= least)
        cuts = np.searchsorted(row[keep], np.arange(len(begins) + 1))
        yield pa.RecordBatch.from_arrays([
            self.keys[0].take(pa.array(group[begins])), self.prefixes.take(pa.array(prefix[begins])),
            _lists(self.words.take(pa.array(self.word[:n][keep])), cuts), _lists(pa.array(counts[keep]), cuts),
            pa.array(np.add.reduceat(counts, begins)), pa.array(np.maximum.reduceat(counts, begins))],
            names=[f.split()[0] for f in MERGED.split(", ")])


def merge(rows: DataFrame, least: int) -> DataFrame:
    """The merged stripes, those of spread prefixes in parts: the words that come ``least`` times or more, the largest count
    in ``top`` and the sum of all in ``total``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for batch in batches:
            if batch.num_rows:
                pending.append(pa.Table.from_batches([batch]).select(_STRIPES.names).cast(_STRIPES))
                size += len(batch.column("counts").flatten())
            if size > ENTRIES:
                merged = _Merged(pa.concat_tables(pending))
                # the key that the rows end with may go on in the next ones
                pending, size = [pa.Table.from_batches([merged.last()])], 0
                yield from merged.finished(False, least)
        if pending:
            yield from _Merged(pa.concat_tables(pending)).finished(True, least)

    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, MERGED)


@pandas_udf(LongType())
def _phrase_hash(lang, phrase):
    import pandas as pd
    lists = [p.split(" ") for p in phrase]
    hashed = np.array([xxhash.xxh3_64_intdigest(x) for x in lang], np.uint64)
    for j in range(len(lists[0]) if lists else 0):
        hashed = vocab.follow(hashed, np.array([xxhash.xxh3_64_intdigest(x[j]) for x in lists], np.uint64))
    return pd.Series(hashed.view(np.int64))


def score(a, n, left, right) -> F.Column:
    """floor(1000 * a * n / (left * right))"""
    a, n, left, right = (F.col(c).cast("decimal(18,0)") for c in (a, n, left, right))
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (a * n), left * right)


def collocations(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words that
    come ``least`` times or more, by the score of their weakest cut, without those that a longer one
    with the same count holds."""
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    frequent = hot = sizes = None
    buckets = 1
    found, tops = [], []
    for level in range(longest):
        merged = materialise(merge(stripes(docs, level, buckets, frequent, hot), least), f"stripes-{level}")
        entries = merged.select("lang", "prefix", F.inline(F.arrays_zip("next", "counts")))
        phrase = F.concat_ws(" ", "prefix", "next") if level else F.col("next")
        entries = entries.select("lang", phrase.alias("phrase"), F.lit(level + 1).alias("words"), F.col("counts").alias("a"))
        found.append(entries)
        if level:
            tops.append(merged.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("top").alias("more")))
        else:
            sizes = merged.groupBy("lang").agg(F.sum("total").alias("n"))
            buckets = 1 + (merged.agg(F.sum("total")).first()[0] or 0) // BUCKET_WORDS
        if level + 1 < longest:
            hashed = materialise(entries.select("a", _phrase_hash("lang", "phrase").alias("hash")), f"frequent-{level + 1}")
            frequent, hot = sieve.build(hashed, "hash"), sieve.build(hashed.where(F.col("a") >= HOT), "hash")
    found = materialise(reduce(DataFrame.unionAll, found), "phrases")

    candidates = found.where("words > 1")
    suffix = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    held = candidates.where("words > 2").select("lang", suffix.alias("phrase"), F.col("a").alias("more"))
    more = reduce(DataFrame.unionAll, [*tops, held]).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    kept = candidates.join(more, ["lang", "phrase"], "left").where("coalesce(more, 0) < a").drop("more")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(found.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    cuts = cuts.join(sizes, "lang").withColumn("score", score("a", "n", "l", "r"))
    weakest = F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("w")
    scored = cuts.groupBy("lang", "phrase").agg(weakest).select("lang", "phrase", "w.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
