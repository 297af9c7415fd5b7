"""Vocabulary, token ids, padding, masks and batches (K1-K9).

Ids come from a vocabulary computed on the corpus: reserved tokens first, then words by
(count desc, word). Text <-> ids: a vocabulary small enough to broadcast is looked up in Arrow batches,
each row's array where it is, without a shuffle. Of a larger one the heavy words are broadcast, the tail is
found by a shuffle, and sequences are rebuilt for each row, so a group is one text, never a hot word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from taffeta.functions.taf import BOS, EOS, PAD
from taffeta.operators.joins import heavy_join, is_small
from taffeta.operators.ranking import global_rank, hashed_rank
from taffeta.session import drop_shuffles, materialise

# Reserved tokens in id order: padding, begin and end of sequence, then the
# configured additional tokens and additional special tokens (whole words, without the
# byte-level space marker).
RESERVED = (PAD, BOS, EOS, "TAF", "BECMG", "TEMPO", "LAST", "NO", "AMDS", "RMK", "COR")
# The special ones: the first three and the configured additional special tokens.
SPECIALS = (PAD, BOS, EOS, "LAST", "NO", "AMDS", "RMK", "COR")
PAD_ID = 0
MAX_LENGTH = 256
BATCH_SIZE = 8
PAD_MULTIPLE = 20
#: Bytes of a digest that cuts are sorted by at first: two of a billion cuts are equal in them about one time in 37.
LEAD = 8


def reserved_vocab(spark: SparkSession, reserved=RESERVED) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(reserved)], "token string, id bigint") \
                .withColumn("count", F.lit(None).cast("bigint"))


def build_vocab(tokens: DataFrame, token_col: str = "token", reserved=RESERVED) -> DataFrame:
    """K1: (token, id, count). Counting is a partial-aggregated group-by; ranking uses the
    distributed global rank, so a vocabulary larger than one task's memory still works."""
    spark = tokens.sparkSession
    counts = (tokens.groupBy(F.col(token_col).alias("token")).agg(F.count(F.lit(1)).alias("count"))
                    .where(~F.col("token").isin(list(reserved))))
    ranked = global_rank(counts, [F.col("count").desc(), F.col("token")], "rank")
    words = ranked.select("token", (F.col("rank") + len(reserved) - 1).alias("id"), "count")
    return reserved_vocab(spark, reserved).unionByName(words)


def _exploded(df: DataFrame, key_cols, array: str, value: str, stored: bool) -> DataFrame:
    """Each item of each row's array, with the row's number, and the row's keys beside the first one: rows with
    equal keys stay apart. ``stored`` if the items are read more than once."""
    rows = df.select(*key_cols, F.col(array).alias("_array"), F.monotonically_increasing_id().alias("_row"))
    rows = materialise(rows, "numbered-rows") if stored else rows
    ex = rows.select("_row", F.struct(*key_cols).alias("_keys"), F.posexplode_outer("_array").alias("_pos", value))
    return ex.withColumn("_keys", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_keys")))


def _gathered(found: DataFrame, value: str, keep: F.Column, out: F.Column) -> DataFrame:
    """Each row's values in order. A group is one row's array, never a hot word."""
    pair = F.when(F.col("_pos").isNotNull() & keep, F.struct(F.col("_pos").alias("pos"), F.col(value).alias("x")))
    rows = found.groupBy("_row").agg(F.first("_keys", ignorenulls=True).alias("_keys"), F.array_sort(F.collect_list(pair)).alias("_p"))
    return rows.select("_keys.*", out)


def _small_pairs(vocab: DataFrame, of: str, to: str) -> pa.Table | None:
    """The vocabulary's (of, to), of at most ``SMALL`` rows, for the broadcast; None if a key stands twice,
    which only a join answers with every value."""
    types = {"token": StringType(), "id": LongType()}
    if any(vocab.schema[c].dataType != types[c] for c in (of, to)):
        return None
    pairs = vocab.where(F.col(of).isNotNull()).select(of, to).toArrow().combine_chunks()
    return pairs if pc.count_distinct(pairs[of]).as_py() == len(pairs) else None


def _looked_up(spark: SparkSession, pairs: pa.Table, lists: Column, join: bool = False, default: int | None = None) -> Column:
    """Each item's value, null or ``default`` where it has none; with ``join`` the found ones as one text."""
    shared = spark.sparkContext.broadcast((pairs[0].combine_chunks(), pairs[1].combine_chunks()))

    def run(arrays: pa.Array) -> pa.Array:
        keys, values = shared.value
        items, ends = arrays.flatten(), arrays.offsets.to_numpy()
        ends = ends - ends[0]
        found = values.take(pc.index_in(items, value_set=keys.cast(items.type), skip_nulls=True))
        if not join:
            found = found if default is None else found.fill_null(default)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)
        before = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), found.drop_null()), " ")

    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string" if join else "array<bigint>")(F.coalesce(lists, F.array().cast(f"array<{'bigint' if join else 'string'}>")))


def encode(df: DataFrame, key_cols, vocab: DataFrame, tokens_col: str = "tokens",
           out: str = "ids", unk_id: int | None = None) -> DataFrame:
    """K2: token arrays -> id arrays, for each row. Unknown tokens map to ``unk_id`` (null if None).
    A row without tokens keeps its place, with an empty array. A vocabulary too large to broadcast is
    broadcast in its heavy words, the others are found by a shuffle."""
    small = is_small(vocab)
    pairs = _small_pairs(vocab, "token", "id") if small else None
    if pairs is not None:
        return df.select(*key_cols, _looked_up(df.sparkSession, pairs, F.col(tokens_col), default=unk_id).alias(out))
    known = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"), "count")
    found = heavy_join(_exploded(df, key_cols, tokens_col, "_token", not small), known, ["_token"], how="left", small=small)
    if unk_id is not None:
        found = found.withColumn("_id", F.coalesce("_id", F.lit(unk_id).cast("bigint")))
    return _gathered(found, "_id", F.lit(True), F.transform("_p", lambda x: x["x"]).alias(out))


def decode(df: DataFrame, key_cols, vocab: DataFrame, ids_col: str = "ids", out: str = "text",
           skip=SPECIALS) -> DataFrame:
    """K8: ids -> text, special tokens and unknown ids skipped, words joined by a space. A row of
    nothing else keeps its place, with an empty text."""
    words = vocab.where(~F.col("token").isin(list(skip)))
    small = is_small(vocab)
    pairs = _small_pairs(words, "id", "token") if small else None
    if pairs is not None:
        ids = F.col(ids_col).cast("array<bigint>")
        return df.select(*key_cols, _looked_up(df.sparkSession, pairs, ids, join=True).alias(out))
    known = words.select(F.col("id").alias("_of"), F.col("token").alias("_word"), "count")
    found = heavy_join(_exploded(df, key_cols, ids_col, "_of", not small), known, ["_of"], how="left", small=small)
    text = F.array_join(F.transform("_p", lambda x: x["x"]), " ")
    return _gathered(found, "_word", F.col("_word").isNotNull(), text.alias(out))


def truncate(c, max_length: int = MAX_LENGTH) -> F.Column:
    """K4."""
    return F.slice(c, 1, max_length)


def make_batches(df: DataFrame, order_cols, batch_size: int = BATCH_SIZE, out: str = "batch", hashed: bool = False) -> DataFrame:
    """K9: consecutive groups of ``batch_size`` rows in a repeatable order (global rank); ``hashed`` if the order is
    that of one column of digests."""
    r = hashed_rank(df, *order_cols, "_r") if hashed else global_rank(df, order_cols, "_r")
    return r.withColumn(out, F.floor((F.col("_r") - 1) / batch_size)).withColumnRenamed("_r", "row_in_order")


def pad_to(ids, length, side: str = "left", pad_id: int = PAD_ID) -> F.Column:
    n = F.greatest(length - F.size(ids), F.lit(0))
    fill = F.array_repeat(F.lit(pad_id).cast("bigint"), n.cast("int"))
    return F.concat(fill, ids) if side == "left" else F.concat(ids, fill)


def mask_for(ids, length, side: str = "left") -> F.Column:
    """K7: 1 for real tokens, 0 for padding, built from lengths."""
    n = F.greatest(length - F.size(ids), F.lit(0)).cast("int")
    zeros, ones = F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), F.size(ids))
    return F.concat(zeros, ones) if side == "left" else F.concat(ones, zeros)


def batch_cuts(cuts: DataFrame, order_cols, lengths: dict[str, str], batch_size: int = BATCH_SIZE,
               multiple: int | None = None) -> DataFrame:
    """K9 + K5/K6 before there are texts: ``batch`` of each cut in the order of its digest and, for each column or
    expression of ``lengths``, the batch's longest (rounded up to ``multiple``) under the name given there. ``cuts`` should
    hold numbers and the digest only: one shuffle sorts them, by the digests' first bytes, and finds the longest of
    each batch; its files go at once. The batches that lie across two such groups, two at most for each, are put
    together afterwards. Digests cross the shuffle in their first ``LEAD`` bytes, which tell cuts apart; only where
    cuts that are equal in them fall into two batches is everything sorted again, by whole digests."""
    (digest,) = order_cols
    kept = [c for c in cuts.columns if c != digest]
    for order in (F.substring(digest, 1, LEAD), F.col(digest)):
        d = make_batches(cuts.withColumn(digest, order), order_cols, batch_size, hashed=True)
        in_group = Window.partitionBy("_group", "batch")
        first, last = F.col("_before"), F.col("_before") + F.col("_size") - 1
        across = F.col("batch").isin(F.floor(first / batch_size), F.floor(last / batch_size))
        torn = F.col("_again") & (F.pmod(F.col("row_in_order") - 1, F.lit(batch_size)) == 0)
        d = d.select(*kept, "batch", "_group", across.alias("_across"), F.coalesce(torn, F.lit(False)).alias("_torn"))
        d = d.withColumns({name: F.max(F.expr(c)).over(in_group) for c, name in lengths.items()}).drop("_group")
        d = materialise(d, "batches")
        drop_shuffles(cuts.sparkSession)
        if d.where("_torn").isEmpty():
            break
    d = d.drop("_torn")
    whole = d.where("_across").groupBy("batch").agg(*[F.max(name).alias(f"_{name}") for name in lengths.values()])
    d = d.join(F.broadcast(whole), "batch", "left")

    def longest(name: str) -> Column:
        c = F.coalesce(f"_{name}", name)
        return (F.ceil(c / multiple) * multiple).cast("int") if multiple else c

    return d.withColumns({name: longest(name) for name in lengths.values()}).drop("_across", *[f"_{name}" for name in lengths.values()])


def with_cuts(records: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """The rows of each record's cuts: a record crosses the shuffle once, for all of them; a cut is a few numbers."""
    return cuts.join(records, key).select(*records.columns, *[c for c in cuts.columns if c != key])


def pad_batch(df: DataFrame, ids_col: str = "ids", batch_col: str = "batch", side: str = "left",
              multiple: int | None = None) -> DataFrame:
    """K5/K6: pad every sequence to its batch's longest (rounded up to ``multiple``).
    The batch maximum is a small group-by joined back on the batch id."""
    mx = df.groupBy(batch_col).agg(F.max(F.size(ids_col)).alias("_len"))
    length = F.col("_len")
    if multiple:
        length = (F.ceil(F.col("_len") / multiple) * multiple).cast("int")
    d = df.join(mx, batch_col).withColumn("_target", length)
    return d.withColumns({"padded": pad_to(F.col(ids_col), F.col("_target"), side),
                          "attention_mask": mask_for(F.col(ids_col), F.col("_target"), side)}) \
            .drop("_len", "_target")

