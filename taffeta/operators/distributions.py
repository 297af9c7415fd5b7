"""Next-word distributions and their shaping by strategy.

The model is a table (context, token, count, total, p). Shaping rules are relational:
temperature is a power and a renormalisation, top-k a rank filter, top-p a cumulative-mass
filter, greedy an arg-max, sampling a draw against the cumulative mass.

Order inside a context is (count desc, token): temperature is monotonic, so this is the order
of the shaped probabilities too, and it is exact (integers), whatever the engine's float pow.
Cumulative masses are summed as decimals (15 places) or as integer counts, so the keep/drop
decision does not depend on the summation order of floats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taffeta.functions.generators import explode_rows

from taffeta.operators.joins import heavy_join
from taffeta.operators.strategies import PARAMS_TYPE, STRATEGIES

CUM_TYPE = "decimal(38,15)"


def ngram_model(seqs: DataFrame, seq_col: str = "seq", n: int = 2) -> DataFrame:
    """Next-word counts after every context of ``n`` tokens -> probabilities."""
    size = F.size(seq_col)
    # only the place is generated; context and token are cut out of the sequence beside it, in generated code
    at = explode_rows(seqs, [seq_col], F.when(size > n, F.sequence(F.lit(n), size - 1)), "_j")
    ev = at.select(F.array_join(F.slice(seq_col, F.col("_j") - n + 1, n), " ").alias("context"),
                   F.element_at(seq_col, F.col("_j") + 1).alias("token"))
    counts = ev.groupBy("context", "token").agg(F.count(F.lit(1)).alias("count"))
    # totals over the aggregated (context, token) table: one exchange by context, and the
    # upstream (templating, de-dup, counting) is computed once rather than again for a join
    total = F.sum("count").over(Window.partitionBy("context"))
    return counts.withColumn("total", total).withColumn("p", F.col("count") / F.col("total"))


def _renorm(d: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Divide by the per-key sum; rows here are distinct (key, token) pairs, bounded per key by
    the vocabulary."""
    return d.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy(*keys)))


def apply_temperature(model: DataFrame, temperature: float, keys=("context",)) -> DataFrame:
    """p^(1/T), renormalised per context."""
    d = model.withColumn("_q", F.pow(F.col("p"), F.lit(1.0 / temperature)))
    return _renorm(d, keys, "_q", "p").drop("_q")


def top_k_filter(model: DataFrame, k: int, keys=("context",), salts: int = 8) -> DataFrame:
    """Keep the k most likely tokens per context (k=0 keeps all), renormalise.
    Two stages: top k per (context, salt), then top k of those <= k*salts rows, so a context
    with a huge number of distinct next tokens is split over several tasks first."""
    if k <= 0:
        return model
    order = [F.col("count").desc(), F.col("token")]
    d = model.withColumn("_s", F.pmod(F.xxhash64("token"), F.lit(salts)))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order)))
    d = d.where(F.col("_r") <= k)
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    d = d.where(F.col("_r") <= k).drop("_s", "_r")
    return _renorm(d, keys, "p", "p")


def top_p_filter(model: DataFrame, top_p: float, keys=("context",)) -> DataFrame:
    """Keep the smallest prefix (most likely first) whose mass reaches ``top_p``: a token is
    kept while the mass strictly before it is < top_p; renormalise."""
    w = (Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("token"))
               .rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum(F.round("p", 15).cast(CUM_TYPE)).over(w), F.lit(0).cast(CUM_TYPE))
    d = model.withColumn("_before", before).where(F.col("_before") < F.lit(float(top_p))).drop("_before")
    return _renorm(d, keys, "p", "p")


def greedy_next(model: DataFrame, keys=("context",)) -> DataFrame:
    """The most likely next token; ties go to the smallest token."""
    return model.groupBy(*keys).agg(
        F.min_by("token", F.struct((-F.col("count")).alias("c"), F.col("token"))).alias("token"))


def uniform7(key) -> F.Column:
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint")


def sample_next(model: DataFrame, seed: str = "taffeta", keys=("context",)) -> DataFrame:
    """One repeatable draw per context. u = 7 hex digits of md5(seed || context) / 16^7;
    the drawn token is the first (in likelihood order) whose cumulative count exceeds u*total,
    compared in integers: cum*16^7 > u7*total."""
    order = Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("token"))
    cum = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0))
    u7 = uniform7(F.concat(F.lit(seed), F.concat_ws(" ", *[F.col(k) for k in keys])))
    d = model.withColumns({"_cum": cum, "_u": u7})
    scale = F.lit(16 ** 7).cast("bigint")
    hit = ((F.col("_cum") * scale) > (F.col("_u") * F.col("total"))) & \
          (((F.col("_cum") - F.col("count")) * scale) <= (F.col("_u") * F.col("total")))
    return d.where(hit).select(*keys, "token")


def sampling_strategies(canonical_only: bool = True):
    rows = [r for r in STRATEGIES if r[2] and (r[0] == r[1] or not canonical_only)]
    names = [f.name for f in PARAMS_TYPE.fields]
    return [(r[0], dict(zip(names, r[2:]))) for r in rows]


def shape_by_strategy(model: DataFrame, keys=("context",)) -> DataFrame:
    """Every sampling strategy applied to every context in one plan: temperature, then
    top-k, then top-p, parameters taken from the strategy row. The strategies are a fixed
    literal array (a generator, not a join); all windows share the (strategy, context)
    partitioning, so there is one shuffle for the whole chain."""
    strat = F.array(*[F.struct(F.lit(n).alias("strategy"),
                               F.lit(v["temperature"]).cast("double").alias("temperature"),
                               F.lit(v["top_k"]).cast("int").alias("top_k"),
                               F.lit(v["top_p"]).cast("double").alias("top_p"))
                      for n, v in sampling_strategies()])
    # likelihood order is the same for every strategy: rank once per context on the model,
    # then the fanned-out windows sort on that one integer
    m = model.withColumn("_rk", F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("token"))))
    d = m.select(*keys, "token", "count", "p", "_rk", F.inline(strat))
    ordered = Window.partitionBy("strategy", *keys).orderBy("_rk")
    # full-partition frame on the same ordering: every window shares one exchange and one sort
    part = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    q = F.pow(F.col("p"), 1.0 / F.coalesce(F.col("temperature"), F.lit(1.0)))
    d = d.withColumn("q", q).withColumn("q", F.col("q") / F.sum("q").over(part))
    k = F.coalesce(F.col("top_k"), F.lit(0))
    d = d.withColumn("_r", F.row_number().over(ordered)).where((k <= 0) | (F.col("_r") <= k))
    d = d.withColumn("q", F.col("q") / F.sum("q").over(part))
    before = F.coalesce(F.sum(F.round("q", 15).cast(CUM_TYPE)).over(
        ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(CUM_TYPE))
    d = d.withColumn("_before", before)
    d = d.where(F.col("top_p").isNull() | (F.col("_before") < F.col("top_p")))
    d = d.withColumn("q", F.col("q") / F.sum("q").over(part))
    return d.select("strategy", *keys, "token", F.col("q").alias("p"))


def no_repeat_ngram(candidates: DataFrame, seqs: DataFrame, key: str, seq_col: str = "seq",
                    size: int = 2) -> DataFrame:
    """Drop candidate next tokens that would complete an n-gram already in the sequence
    (n = ``size``): the banned set is every token that followed the current last n-1 tokens
    earlier in the sequence. A left-anti join on (key, token); the rest is renormalised."""
    n = F.size(seq_col)
    tail = F.slice(seq_col, n - size + 2, size - 1)
    js = F.filter(F.sequence(F.lit(size - 1), F.greatest(n - 1, F.lit(size - 1))), lambda j: j < n)
    banned_arr = F.transform(F.filter(js, lambda j: F.slice(seq_col, j - size + 2, size - 1) == tail),
                             lambda j: F.element_at(seq_col, j + 1))
    banned = explode_rows(seqs, [key], F.array_distinct(banned_arr), "token")
    kept = candidates.join(banned, [key, "token"], "left_anti")
    return _renorm(kept, [key], "count", "p")


def banned_tokens(seqs: DataFrame, model: DataFrame, key: str, seq_col: str = "seq", size: int = 2) -> DataFrame:
    """N8 at every place of every sequence, as what it changes in the shared model of contexts of
    ``size`` - 1 tokens: (key, context, token, banned_after, count, remaining).

    ``token`` is not to follow ``context`` at places after ``banned_after`` (in tokens), where the n-gram
    stood first. There the model's other tokens have p = their count / ``remaining``, the context's total
    without the counts of all that is banned so far; 0 remaining means that nothing is left to follow. Bans
    of contexts that don't come again are left out, so the rows grow with the sequences' length, and
    whatever the model holds for a context is never copied. One exchange of whole sequences brings the
    places of a key together, one more the bans to a large model; a context of many sequences is broadcast.
    """
    m, n = size - 1, F.size(seq_col)
    # sequences are dealt by their key before their places are: the places of a key are together then
    at = explode_rows(seqs.select(key, seq_col).repartition(key), [key, seq_col], F.when(n >= m, F.sequence(F.lit(m), n)), "place")
    rows = at.select(key, "place", F.array_join(F.slice(seq_col, F.col("place") - m + 1, m), " ").alias("context"),
                     F.get(seq_col, F.col("place")).alias("token"))
    first = rows.groupBy(key, "context", "token").agg(F.min("place").alias("banned_after"), F.max("place").alias("_last"))
    first = first.withColumn("_last", F.max("_last").over(Window.partitionBy(key, "context")))
    bans = first.where(F.col("token").isNotNull() & (F.col("banned_after") < F.col("_last"))).drop("_last")
    known = heavy_join(bans, model.select("context", "token", "count", "total"), ["context", "token"])
    so_far = Window.partitionBy(key, "context").orderBy("banned_after").rowsBetween(Window.unboundedPreceding, 0)
    return known.withColumn("remaining", F.col("total") - F.sum("count").over(so_far)) \
                .select(key, "context", "token", "banned_after", "count", "remaining")


def allowed_next(model: DataFrame, bans: DataFrame, at: DataFrame, key: str) -> DataFrame:
    """The distributions at given places (key, context, place): the context's tokens that are not banned
    there, with p. For the places that are asked for; their contexts' tokens are copied."""
    here = at.join(bans.select(key, "context", F.col("token").alias("_banned"), "banned_after", "count", "remaining"),
                   [key, "context"], "left").where("banned_after is null or banned_after < place or _banned is null")
    gone = here.groupBy(key, "context", "place").agg(F.collect_set("_banned").alias("_gone"), F.min("remaining").alias("_left"))
    asked = at.join(gone, [key, "context", "place"], "left").join(model, "context")
    kept = asked.where("_gone is null or not array_contains(_gone, token)")
    p = F.col("count") / F.coalesce("_left", "total")
    return kept.select(key, "context", "place", "token", "count", p.alias("p"))
