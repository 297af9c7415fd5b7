"""MinHash near-duplicate detection with circulant signatures.

A text's set of word shingles is hashed into a universe of 2**20 places. One permutation scatters
the places; a second one, circularly shifted by k, gives the k-th coordinate of the signature, so
two permutations give all of them. Bands of the signature are the buckets. Each pair that shares a
bucket is confirmed on the full shingle sets of the whole texts (100 * shared >= percent * union),
and connected components of the confirmed links are the groups.

Equal sets are one node, so copies never meet each other. A bucket of few nodes gives its pairs,
each once over all bands. A larger one gives a star around its first node. Where that leaves more
than one component, nodes with so many shingles of their own that no other set can be like theirs are
set aside, and those outside a bucket's largest component are searched for among all of its members, in
blocks of a bounded number of nodes, so that no link between two members of a bucket is lost and none
of the groups is gathered in one task. With 32 bands of 4 coordinates a pair at 0.8 shares no bucket with a
probability of 5e-8.

Defined cases: null and empty texts and texts without words have an empty set and are linked with
nothing. Repeated rows are copies of one another. ``component_id`` is the smallest doc_id of the
group (null if none has one); a row is kept if that is its own. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taffeta.llm.batches import lean
from taffeta.llm.components import components
from taffeta.llm.hashing import Words, blocks, mix
from taffeta.llm.numbering import numbered
from taffeta.session import drop_shuffles, materialise

UNIVERSE = 1 << 20
BANDS, ROWS = 32, 4
#: Buckets up to so many nodes give all their pairs; larger ones are searched in blocks of about BLOCK.
FEW, BLOCK = 16, 512


@cache
def _permutations(width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and every window of the second one: row i holds the values that
    the shifts 0, 1, ... give place i."""
    rng = np.random.default_rng(seed)
    scatter, ranks = rng.permutation(UNIVERSE), rng.permutation(UNIVERSE).astype(np.uint32)
    around = np.concatenate([ranks, ranks[: width - 1]])
    return scatter, np.lib.stride_tricks.sliding_window_view(around, width)


def signature(shingles: np.ndarray, width: int = BANDS * ROWS) -> np.ndarray:
    scatter, shifted = _permutations(width)
    places = scatter[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = shifted[places[:4096]].min(axis=0)
    for i in range(4096, len(places), 4096):
        np.minimum(out, shifted[places[i : i + 4096]].min(axis=0), out=out)
    return out


def bands(sig: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; its number is part of it."""
    parts = sig.reshape(n_bands, rows).astype(np.uint64)
    key = np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = mix(key ^ (parts[:, j] + np.uint64(j << 32)))
    return key.view(np.int64)


def _node(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def _hashed(rows: DataFrame, words: int) -> DataFrame:
    """rid, doc_id, n, node, bands of each row (rid, doc_id, text), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                sets = Words(texts[a:b]).shingles(words)
                keys = [bands(signature(s)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    *batch.slice(a, b - a).columns[:2], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ], names=["rid", "doc_id", "n", "node", "bands"])

    return materialise(rows.mapInArrow(lean(run), "rid long, doc_id long, n long, node long, bands array<long>"), "minhash-rows")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are alike; the texts are joined to both."""
    rows = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
            for i, j in blocks([x + y for x, y in zip(left, right)]):
                own = {**dict(zip(a[i:j], left[i:j])), **dict(zip(b[i:j], right[i:j]))}
                sets = dict(zip(own, Words(list(own.values())).shingles(words)))
                good = [k for k in range(i, j) if _linked(sets[a[k]], sets[b[k]], percent)]
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long")


def search(nodes: list[int], parts: list[int], sets: list[np.ndarray], percent: int, seeks: list[bool]) -> list[tuple[int, int]]:
    """Links that join the parts of a block: each node that ``seeks`` against all nodes that are not in its
    part yet."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner_by_column, at = owner[order], np.concatenate([[0], np.cumsum(np.bincount(column))])
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    size, part, links = np.diff(first), np.array(parts), []
    for i in np.flatnonzero(seeks):
        other = part != part[i]
        if not other.any():
            break
        columns = column[first[i] : first[i + 1]]
        shared = np.bincount(np.concatenate([owner_by_column[at[c] : at[c + 1]] for c in columns]), minlength=len(sets))
        for j in np.flatnonzero(other & (100 * shared >= percent * (size + size[i] - shared))):
            if part[j] != part[i]:
                links.append((nodes[i], nodes[j]))
                part[part == part[j]] = part[i]
    return links


def _set_rows(rows: DataFrame, words: int) -> DataFrame:
    """(node, n, shingle): the full sets of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                sets = Words(texts[a:b]).shingles(words)
                sizes = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    nodes.slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), sizes))),
                    pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(np.concatenate(sets).view(np.int64)),
                ], names=["node", "n", "shingle"])

    return rows.select("node", "text").mapInArrow(lean(run), "node long, n long, shingle long")


def _linkable(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Members without those that have too many shingles of their own for any link: what a linked pair
    shares is at least ``percent`` of either set, and is in both."""
    rows = _set_rows(texts.join(members.select("node").distinct(), "node"), words)
    own = rows.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("node").alias("node"), F.min("n").alias("n")).where("holders = 1")
    alone = own.groupBy("node").agg(F.count("*").alias("own"), F.min("n").alias("n")).where(f"100 * (n - own) < {percent} * n")
    return members.join(alone.select("node"), "node", "left_anti")


def _outside(members: DataFrame) -> DataFrame:
    """Members (bucket, node, part) of the buckets that are in parts, of those with the same members one, with
    its counts of blocks. Those outside the largest part (``outside``) are sought among all members."""
    parts = members.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("all"), F.sum(F.col("node") % 1000003).alias("sum"))
    sizes = (parts.groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts"),
                                         F.expr("bit_xor(all)").alias("all"), F.sum("sum").alias("sum"))
             .where("parts > 1").groupBy("n", "all", "sum").agg(F.min("bucket").alias("bucket"), F.min_by("top", "bucket").alias("top")))
    n_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("bucket", F.col("top.part").alias("main"), n_blocks(F.col("n")).alias("n_blocks"), n_blocks(F.col("n") - F.col("top.n")).alias("n_outside"))
    return members.join(sizes, "bucket").withColumn("outside", F.col("part") != F.col("main")).drop("main")


def _search_blocks(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components within large buckets (``_outside``). Two nodes of different parts are not both in
    the largest one, so every block of the nodes outside it is searched against each block of all members."""
    place = F.xxhash64("node")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    seeking = members.where("outside").select("bucket", "node", "part", F.pmod(place, F.col("n_outside")).cast("int").alias("x"), numbers("n_blocks").alias("y"), F.lit(True).alias("seeks"))
    sought = members.select("bucket", "node", "part", numbers("n_outside").alias("x"), F.pmod(place, F.col("n_blocks")).cast("int").alias("y"), F.lit(False).alias("seeks"))
    # a node that meets its own block is there once
    rows = seeking.union(sought).groupBy("bucket", "x", "y", "node", "part").agg(F.max("seeks").alias("seeks")).join(texts, "node")

    def run(pdf):
        import pandas as pd
        pdf = pdf.sort_values("node")
        sets = Words(pdf["text"].tolist()).shingles(words)
        found = search(pdf["node"].tolist(), pdf["part"].tolist(), sets, percent, pdf["seeks"].tolist())
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("bucket", "x", "y").applyInPandas(run, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and kept of each row; ``rid`` is the number that
    ``numbered`` gave it (rows without ``_rid`` are numbered here)."""
    if "_rid" not in docs.columns:
        docs = numbered(docs.select("doc_id", text))
    whole = docs.select(F.col("_rid").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = _hashed(whole, words)
    nodes = materialise(rows.where("n > 0").groupBy("node").agg(
        F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count("*").alias("copies"),
        F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "minhash-nodes")
    keys = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = materialise(keys.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("lead"))
                         .where("members > 1"), "minhash-buckets")
    found = materialise(keys.join(shared, "bucket"), "minhash-members")

    def pairs_of(members):
        n = F.size(members)
        later = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(
            F.slice(members, i + 1, n), lambda y: F.struct(members[i - 1].alias("x"), y.alias("y"))))
        return F.explode(F.flatten(later))

    lists = (found.where(F.col("members") <= FEW).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("m"))
             .select("m").distinct())
    alike = F.expr(f"100 * least(p.x.n, p.y.n) >= {percent} * greatest(p.x.n, p.y.n)")
    pairs = lists.select(pairs_of(F.col("m")).alias("p")).where(alike).select(F.col("p.x.node").alias("a"), F.col("p.y.node").alias("b"))
    stars = found.where((F.col("members") > FEW) & (F.col("node") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    pairs = materialise(pairs.union(stars).distinct(), "minhash-pairs")
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node").join(nodes.select("node", "rid"), "node")
    texts = materialise(whole.select("rid", "text").join(wanted, "rid").select("node", "text"), "minhash-texts")
    drop_shuffles(spark)
    links = materialise(_confirm(pairs, texts, words, percent), "minhash-links")
    drop_shuffles(spark)
    groups = materialise(components(links), "minhash-groups")

    large = found.where(F.col("members") > FEW).join(groups, "node", "left")
    large = materialise(large.select("bucket", "node", F.coalesce("root", "node").alias("part")), "minhash-large")
    # buckets that are still in parts
    open_ = large.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("bucket")
    members = materialise(large.join(open_, "bucket").select("bucket", "node", "part"), "minhash-open")
    members = materialise(_outside(_linkable(members, texts, words, percent)), "minhash-outside")
    more = materialise(_search_blocks(members, texts, words, percent), "minhash-more")
    if not more.isEmpty():
        groups = materialise(components(more.union(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))), "minhash-groups")

    joined = nodes.select("node", "least", "copies").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = materialise(joined.groupBy("root").agg(F.min("least").alias("component"), F.sum("copies").alias("size")).where("size > 1"), "minhash-least")
    ids = materialise(joined.select("node", "root").join(least, "root").select("node", "component"), "minhash-ids")
    # a row of a lone node, or without a set, is its own group
    out = rows.select("rid", "doc_id", "n", "node").join(ids.withColumn("grouped", F.lit(True)), "node", "left")
    group = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("rid", "doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(groups: DataFrame) -> DataFrame:
    """(_rid) of one row of each group: its first one with the smallest doc_id. A row without
    shingles is a group of its own, and so is one whose group has no doc_id at all."""
    alone = (F.col("n_shingles") == 0) | F.col("component_id").isNull()
    first = (groups.where(~alone & F.col("kept")).groupBy("component_id").agg(F.min("rid").alias("_rid")).select("_rid"))
    return first.union(groups.where(alone).select(F.col("rid").alias("_rid")))
