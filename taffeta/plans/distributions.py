"""Next-word distribution queries (N1-N8) over the TAF corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from taffeta.functions import taf
from taffeta.functions.text import py_split_ws
from taffeta.operators import distributions as N
from taffeta.operators import metadata as M
from taffeta.plans.corpus import PAIRS_BODY
from taffeta.plans.fixtures import duckdb_cte
from taffeta.plans.fixtures import taf_records
from taffeta.plans.registry import query
from taffeta.plans.sqlparts import extract, split_ws
from taffeta.session import materialise

MODEL_BODY = PAIRS_BODY + f"""
, norms as (select distinct array_to_string(w, ' ') as norm from w where len(w) > 1),
seqs as (select ['{taf.BOS}'] || string_split(norm, ' ') || ['{taf.EOS}'] as s from norms),
ng as (select array_to_string(s[j-1:j], ' ') as context, s[j+1] as token
       from (select s, unnest(range(2, len(s))) as j from seqs)),
model as (select context, token, count(*) as count, cast(sum(count(*)) over (partition by context) as bigint) as total,
          count(*) / sum(count(*)) over (partition by context) as p from ng group by context, token),
ordered as (select *, row_number() over (partition by context order by count desc, token) as r,
       coalesce(sum(count) over (partition by context order by count desc, token
                rows between unbounded preceding and 1 preceding), 0) as cum_before from model)
"""
MODEL_CTE = duckdb_cte(["taf_records"]) + MODEL_BODY


def taf_seqs(spark, sf_dir):
    recs = M.template_records(taf_records(spark, sf_dir))
    # a test of the key alone would be pushed below the de-dup and derive every text once more; this one waits
    norm = recs.select(F.array_join(py_split_ws("templated"), " ").alias("norm")) \
               .groupBy("norm").agg(F.max(F.instr("norm", " ")).alias("_space"))
    w = F.split("norm", " ")
    return norm.where("_space > 0").select(
        F.concat(F.array(F.lit(taf.BOS)), w, F.array(F.lit(taf.EOS))).alias("seq"))


def taf_model(spark, sf_dir):
    return N.ngram_model(taf_seqs(spark, sf_dir), "seq", 2)


@query("ngram_model", MODEL_CTE + "select context, token, count, total, p from model")
def q_ngram_model(spark, sf_dir):
    return taf_model(spark, sf_dir).select("context", "token", "count", F.col("total").cast("bigint"), "p")


@query("apply_temperature", MODEL_CTE + """
select context, token, pow(p, 1 / 1.5) / sum(pow(p, 1 / 1.5)) over (partition by context) as p from model
""")
def q_apply_temperature(spark, sf_dir):
    return N.apply_temperature(taf_model(spark, sf_dir), 1.5).select("context", "token", "p")


@query("top_k_filter", MODEL_CTE + """
select context, token, p / sum(p) over (partition by context) as p from ordered where r <= 5
""")
def q_top_k_filter(spark, sf_dir):
    return N.top_k_filter(taf_model(spark, sf_dir), 5).select("context", "token", "p")


@query("top_p_filter", MODEL_CTE + """
, kept as (select *, coalesce(sum(cast(round(p, 15) as decimal(38,15))) over (partition by context order by count desc, token
              rows between unbounded preceding and 1 preceding), 0) as before from model)
select context, token, p / sum(p) over (partition by context) as p from kept where before < 0.92::double
""")
def q_top_p_filter(spark, sf_dir):
    return N.top_p_filter(taf_model(spark, sf_dir), 0.92).select("context", "token", "p")


@query("greedy_next", MODEL_CTE + "select context, token from ordered where r = 1")
def q_greedy_next(spark, sf_dir):
    return N.greedy_next(taf_model(spark, sf_dir))


@query("sample_next", MODEL_CTE + """
, u as (select *, cast('0x' || substr(md5('taffeta' || context), 1, 7) as bigint) as u7 from ordered)
select context, token from u
where (cum_before + count) * 268435456 > u7 * total and cum_before * 268435456 <= u7 * total
""")
def q_sample_next(spark, sf_dir):
    return N.sample_next(taf_model(spark, sf_dir))


def _strategy_values_sql():
    rows = []
    for name, v in N.sampling_strategies():
        def lit(x):
            return "null" if x is None else repr(x)
        rows.append(f"('{name}', {lit(v['temperature'])}, {lit(v['top_k'])}, {lit(v['top_p'])})")
    return ("(select strategy, cast(temperature as double) as temperature, cast(top_k as integer) as top_k, "
            "cast(top_p as double) as top_p from (values " + ", ".join(rows) + ") v(strategy, temperature, top_k, top_p))")


@query("shape_by_strategy", MODEL_CTE + f"""
, g as (select s.strategy, s.temperature, s.top_k, s.top_p, m.context, m.token, m.count, m.p
        from model m cross join {_strategy_values_sql()} s),
t as (select *, pow(p, 1.0 / coalesce(temperature, 1.0)) as q0 from g),
t1 as (select *, q0 / sum(q0) over (partition by strategy, context) as q1,
          row_number() over (partition by strategy, context order by count desc, token) as r from t),
k as (select * from t1 where coalesce(top_k, 0) <= 0 or r <= top_k),
k1 as (select *, q1 / sum(q1) over (partition by strategy, context) as q2 from k),
pp as (select *, coalesce(sum(cast(round(q2, 15) as decimal(38,15))) over (partition by strategy, context
           order by count desc, token rows between unbounded preceding and 1 preceding), 0) as before from k1),
pk as (select * from pp where top_p is null or before < top_p)
select strategy, context, token, q2 / sum(q2) over (partition by strategy, context) as p from pk
""")
def q_shape_by_strategy(spark, sf_dir):
    return N.shape_by_strategy(taf_model(spark, sf_dir))


RECS_MODEL = duckdb_cte(["taf_records"]) + MODEL_BODY


@query("no_repeat_ngram", RECS_MODEL + f"""
, full_seqs as (select rec_id, ['{taf.BOS}'] || {split_ws("'TAF [' || tx || ' ' || tn || '] ' || replace(text, 'TAF ', '')")} as s
           from (select rec_id, text, {extract('text', taf.METADATA_TEMPS, 1)} as tx, {extract('text', taf.METADATA_TEMPS, 2)} as tn
                 from taf_records) m where tx is not null),
model1 as (select s[j] as context, s[j+1] as token, count(*) as count, sum(count(*)) over (partition by s[j]) as total
           from (select s, unnest(range(1, len(s))) as j from seqs) group by s[j], s[j+1]),
places as (select rec_id, s[j] as context, s[j+1] as token, j from (select rec_id, s, unnest(range(1, len(s) + 1)) as j from full_seqs)),
ends as (select rec_id, context, max(j) as last from places group by all),
firsts as (select rec_id, context, token, min(j) as banned_after from places where token is not null group by all)
select rec_id, context, token, cast(banned_after as integer) as banned_after, count,
  cast(total - sum(count) over (partition by rec_id, context order by banned_after) as bigint) as remaining
from firsts join ends using (rec_id, context) join model1 using (context, token) where banned_after < last
""")
def q_no_repeat_ngram(spark, sf_dir):
    """Every place of every whole record, against the model of single-token contexts."""
    model = materialise(N.ngram_model(taf_seqs(spark, sf_dir), "seq", 1), "model")  # read for its weight and its keys
    recs = M.template_records(taf_records(spark, sf_dir))
    seqs = recs.select("rec_id", F.concat(F.array(F.lit(taf.BOS)), py_split_ws("templated")).alias("seq"))
    return N.banned_tokens(seqs, model, "rec_id")
