"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target number of words: its weight's share of the mix, at most ``cap`` times its
own size, what is above being shared again by weight. A document of the source is due
``target / size`` copies: the whole part is taken as it is, the fraction is its inclusion
probability. The cube method's flight phase moves these probabilities within blocks of one source
along the null space of two constraints, the block's words and its documents, until all but two
of a block are 0 or 1. The few left of many blocks form the next, far smaller round. The last round
of a source holds back a few documents of spread sizes; with the two that its flight leaves they are
the landing problem, small enough to try every choice.

Blocks hold a bounded number of rows whatever the source's share; only ids and sizes are shuffled.

Defined cases: a null text has size 0; a null source is a source (the last). A source of size 0
takes nothing. Repeated rows count each. An empty table gives no rows. Reruns agree.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taffeta.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
#: Rows of a block, and blocks whose remains form one block of the next round.
BLOCK, FAN_IN = 1024, 512
#: Sources up to which their table is broadcast.
SMALL = 10_000
#: Documents that the last round of a source holds back for the landing.
HELD = 12


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words that each source (in order) gives; weights repeat."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if unit * weight[i] > cap * sizes[i]}
        for i in full or open_:
            out[i] = cap * sizes[i] if full else unit * weight[i]
            left -= out[i] if full else 0
        open_ = open_ - full if full else set()
    return out


def flight(p: np.ndarray, size: np.ndarray, seed: str) -> np.ndarray:
    """Moves probabilities until at most two are left between 0 and 1; the sums of ``p`` and of
    ``p * size`` stay."""
    p, rng = p.astype(float).copy(), random.Random(seed)
    hand: list[int] = []
    for i in [*np.flatnonzero((p > 0) & (p < 1)).tolist()]:
        hand.append(i)
        while len(hand) == 3:
            a, b, c = (float(size[j]) for j in hand)
            u = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
            up = min((((1 - p[j]) if x > 0 else p[j]) / abs(x) for j, x in zip(hand, u) if x), default=0.0)
            down = min(((p[j] if x > 0 else (1 - p[j])) / abs(x) for j, x in zip(hand, u) if x), default=0.0)
            step = up if rng.random() * (up + down) < down else -down
            for j, x in zip(hand, u):
                p[j] = min(1.0, max(0.0, p[j] + step * x))
                if p[j] < 1e-9 or p[j] > 1 - 1e-9:
                    p[j] = round(p[j])
            hand = [j for j in hand if 0 < p[j] < 1]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the last few: of all choices the one nearest in words, then in documents."""
    p, at = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    if len(at):
        choice = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        words = np.abs(choice @ size[at] - float((p[at] * size[at]).sum()))
        docs = np.abs(choice.sum(1) - float(p[at].sum()))
        p[at] = choice[np.lexsort((docs, words))[0]]
    return p


def last_round(p: np.ndarray, size: np.ndarray, seed: str) -> np.ndarray:
    """Flight of all but ``HELD`` spread over the (sorted) sizes, then the landing."""
    left = np.flatnonzero((p > 0) & (p < 1))
    held = left[np.unique(np.linspace(0, len(left) - 1, HELD).round().astype(int))] if len(left) else left
    flying = p.copy()
    flying[held] = 0
    flying = flight(flying, size, seed)
    flying[held] = p[held]
    return landing(flying, size)


def _round(rows: DataFrame, number: int, seed: int) -> DataFrame:
    """A source that has one block left is settled, whatever the others have."""
    def run(key, pdf):
        pdf = pdf.sort_values(["_size", "_id", "_row"], ascending=[False, True, True], kind="stable")
        size = pdf["_size"].to_numpy()
        move = last_round if pdf["_blocks"].iloc[0] <= 1 else flight
        return pdf.assign(_p=move(pdf["_p"].to_numpy(), size, f"{seed}:{number}:{key[0]}:{key[1]}"))

    return rows.groupBy("_rank", "_block").applyInPandas(run, rows.schema)


def copies(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """``rows``: doc_id, source, size and a hash ``row`` that tells rows of one doc_id apart.
    Returns doc_id, row, size, source_size, target, copies, a row for each."""
    spark = rows.sparkSession
    rows = materialise(rows.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                                   F.col("size").alias("_size"), F.col("row").alias("_row")), "mix-sizes")
    # one row for each source, as many as there are weights to give
    found = rows.groupBy("_source").agg(F.sum("_size"), F.count("*")).collect()
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode()))
    want = targets([r[1] for r in found], weights, share, cap)
    known = spark.createDataFrame(
        [(r[0], i, r[1], t, max(1, -(-r[2] // BLOCK))) for i, (r, t) in enumerate(zip(found, want))],
        "_s string, _rank int, _total long, _target double, _blocks int")
    known = F.broadcast(known) if len(found) <= SMALL else known
    due = F.when(F.col("_total") > 0, F.least(F.col("_target") / F.col("_total"), F.lit(cap))).otherwise(0.0)
    rows = (rows.join(known, rows["_source"].eqNullSafe(known["_s"]))
            .withColumn("_whole", F.floor(due).cast("int")).withColumn("_p", due - F.floor(due))
            .withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_id", "_row"), F.col("_blocks")).cast("int"))
            .drop("_s", "_source"))
    most, number, parts = max((-(-r[2] // BLOCK) for r in found), default=1), 0, []
    while True:
        done = materialise(_round(rows, number, seed), f"mix-round{number}")
        if most <= 1:
            parts.append(done)
            break
        left = (F.col("_p") > 0) & (F.col("_p") < 1)
        parts.append(done.where(~left))
        rows = (done.where(left).withColumn("_block", F.floor(F.col("_block") / FAN_IN).cast("int"))
                .withColumn("_blocks", F.ceil(F.col("_blocks") / FAN_IN).cast("int")))
        most, number = -(-most // FAN_IN), number + 1
    settled = parts[0]
    for x in parts[1:]:
        settled = settled.union(x)
    return settled.select(F.col("_id").alias("doc_id"), F.col("_row").alias("row"), F.col("_size").alias("size"),
                          F.col("_total").alias("source_size"), F.col("_target").alias("target"),
                          (F.col("_whole") + F.col("_p").cast("int")).alias("copies"))


def narrow(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text, "source").alias("row"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, with its columns. The
    texts are shuffled once, on the key that joins them and numbers equal rows; the merge join keeps
    it so at every size."""
    id_ = F.coalesce("doc_id", F.lit(-1 << 63)).alias("_id")
    taken = (copies(narrow(docs), **how).groupBy(id_, F.col("row").alias("_row"))
             .agg(F.array_sort(F.collect_list("copies")).alias("_copies"))
             .where(F.element_at("_copies", -1) > 0))
    rows = docs.withColumns({"_id": id_, "_row": F.xxhash64("text", "source")})
    rows = rows.join(taken.hint("merge"), ["_id", "_row"])
    nth = F.row_number().over(Window.partitionBy("_id", "_row").orderBy(F.lit(1)))
    one = F.col("_copies")[0]
    n = F.when(F.size("_copies") == 1, one).otherwise(F.element_at("_copies", F.col("_nth")))
    return (rows.withColumn("_nth", nth).withColumn("_again", F.explode(F.array_repeat(F.lit(0), n)))
            .select(*docs.columns))
