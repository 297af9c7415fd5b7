"""Result-analysis, scoring and strategy queries over the ``taf_results`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from taffeta.functions import taf
from taffeta.functions.text import JS_WS
from taffeta.operators import analysis as A
from taffeta.operators import scoring as E
from taffeta.operators import strategies as S
from taffeta.plans.fixtures import PROMPT_EXAMPLES, duckdb_cte, taf_records, taf_results
from taffeta.plans.registry import query
from taffeta.plans.sqlparts import extract, strip
from taffeta.session import materialise
from taffeta.sources.tables import load_table

RS = duckdb_cte(["taf_results"])
RR = duckdb_cte()
TN = r"(?:(?:TX)(M?\d{2}).+(?:TN)(M?\d{2}))"


def _t(x, g):
    return f"try_cast(replace({extract(x, TN, g)}, 'M', '-') as double)"


FRAME = RS + f"""
, a as (select rec_id, strategy, prompt, completion, {extract('prompt', taf.STATION_AS_IS, 1)} as icao,
  {_t('prompt', 1)} as prompt_TX, {_t('prompt', 2)} as prompt_TN,
  {_t('completion', 1)} as completion_TX, {_t('completion', 2)} as completion_TN from taf_results)
, d as (select *, abs(prompt_TX - completion_TX) as delta_TX, abs(prompt_TN - completion_TN) as delta_TN,
  abs(prompt_TX - completion_TX) + abs(prompt_TN - completion_TN) as delta from a)
, w1 as (select rec_id, strategy, icao, delta, delta / (select max(delta) from d where delta < 20) as normalized
  from d where delta < 20)
"""


def frame(spark, sf_dir):
    return A.temperature_deltas(taf_results(spark, sf_dir))


def stored_frame(spark, sf_dir):
    """The analysis frame, written once, for queries whose plans read it several times (a
    global max plus its rows, group ranges plus counts, pivot values plus the pivot)."""
    cols = ["rec_id", "strategy", "icao", *A.ALL_VARS]
    return materialise(frame(spark, sf_dir).select(*cols), "analysis-frame")


@query("temps_numeric", FRAME + """
select rec_id, strategy, prompt_TX, prompt_TN, completion_TX, completion_TN from d
""")
def q_temps_numeric(spark, sf_dir):
    return frame(spark, sf_dir).select("rec_id", "strategy", *A.TEMP_VARS)


@query("temp_delta", FRAME + """
select rec_id, strategy, icao, delta_TX, delta_TN, delta from d
""")
def q_temp_delta(spark, sf_dir):
    return frame(spark, sf_dir).select("rec_id", "strategy", "icao", *A.DELTA_VARS)


@query("describe_delta", FRAME + """
select variable, count(value) as count, avg(value) as mean, stddev_samp(value) as std, min(value) as min,
  quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75,
  max(value) as max
from (unpivot (select prompt_TX, prompt_TN, completion_TX, completion_TN, delta_TX, delta_TN, delta from d)
      on prompt_TX, prompt_TN, completion_TX, completion_TN, delta_TX, delta_TN, delta
      into name variable value value)
group by variable
""")
def q_describe_delta(spark, sf_dir):
    return A.describe(frame(spark, sf_dir))


@query("delta_std", FRAME + """
select strategy, stddev_samp(delta) as std_delta from d group by strategy
""")
def q_delta_std(spark, sf_dir):
    return A.std_by(frame(spark, sf_dir), ["strategy"])


@query("delta_std_station", FRAME + """
select strategy, icao, stddev_samp(delta) as std_delta from d where icao is not null group by strategy, icao
""")
def q_delta_std_station(spark, sf_dir):
    return A.std_by(frame(spark, sf_dir), ["strategy", "icao"])


#: The strategies of the results fixture, a column each.
PIVOT_STRATEGIES = ("BEAM_SEARCH", "GREEDY", "TOP_K50", "TOP_P92")


@query("delta_pivot", FRAME + """
select icao, """ + ", ".join(f"avg(delta) filter (where strategy = '{s}') as \"{s}\"" for s in PIVOT_STRATEGIES) + """
from d where icao is not null and delta is not null group by icao
""")
def q_delta_pivot(spark, sf_dir):
    return A.pivot_mean(frame(spark, sf_dir), values=list(PIVOT_STRATEGIES))


@query("normalise_delta", FRAME + "select * from w1")
def q_normalise_delta(spark, sf_dir):
    return A.normalise_by_max(stored_frame(spark, sf_dir)).select("rec_id", "strategy", "icao", "delta", "normalized")


@query("normalise_pivot", FRAME + """
, m as (select icao, strategy, avg(delta) as mean_delta from d where icao is not null and delta is not null
        group by icao, strategy)
select icao, strategy, mean_delta, mean_delta / max(mean_delta) over (partition by strategy) as normalized from m
""")
def q_normalise_pivot(spark, sf_dir):
    return A.normalise_pivot(frame(spark, sf_dir))


def _hist_sql(group, bins):
    return FRAME + f"""
, s as (select {group} as g, count(*) as n,
          case when min(normalized) = max(normalized) then min(normalized) - 0.5 else min(normalized) end as lo,
          case when min(normalized) = max(normalized) then max(normalized) + 0.5 else max(normalized) end as hi
        from w1 where {group} is not null group by {group})
, c as (select g, cast(least(greatest(floor((normalized - lo) * {bins} / (hi - lo)), 0), {bins - 1}) as integer) as bin,
          count(*) as cnt from w1 join s on w1.{group} = s.g group by all)
, b as (select g, n, lo, hi, cast(unnest(range(0, {bins})) as integer) as bin from s)
select b.g as {group}, b.bin, lo + b.bin * ((hi - lo) / {bins}) as bin_lo, lo + (b.bin + 1) * ((hi - lo) / {bins}) as bin_hi,
       coalesce(cnt, 0) as count, coalesce(cnt, 0) / (n * ((hi - lo) / {bins})) as density
from b left join c on b.g = c.g and b.bin = c.bin
"""


@query("hist_strategy", _hist_sql("strategy", 3))
def q_hist_strategy(spark, sf_dir):
    return A.histogram(A.normalise_by_max(stored_frame(spark, sf_dir)), "strategy", "normalized", 3)


@query("hist_station", _hist_sql("icao", 100))
def q_hist_station(spark, sf_dir):
    return A.histogram(A.normalise_by_max(stored_frame(spark, sf_dir)), "icao", "normalized", 100)


SAMPLE_COLS = ("rec_id", "strategy", "prompt", "completion", "prompt_TX", "completion_TX", "delta_TX",
               "prompt_TN", "completion_TN", "delta_TN")


@query("sample_rows", FRAME + f"""
select {', '.join(SAMPLE_COLS)} from d
order by md5(concat_ws('|', 'taffeta', cast(rec_id as varchar), strategy)), rec_id, strategy limit 20
""")
def q_sample_rows(spark, sf_dir):
    return A.sample_rows(frame(spark, sf_dir).select(*SAMPLE_COLS), 20, ["rec_id", "strategy"])


# ---- generated text, editor rules -------------------------------------------------------------
def change_groups_sql(x):
    marked = f"regexp_replace(replace({x}, chr(10), ''), '(BECMG|TEMPO)', chr(1) || '\\1', 'g')"
    return (f"list_transform(list_filter(string_split({marked}, chr(1)), lambda s: s <> ''), "
            f"lambda s: {strip('s')})")


GEN = RS + f"""
, g as (select rec_id, strategy, prompt, completion, {change_groups_sql('prompt || completion')} as lines
        from taf_results)
, x as (select *, substr(array_to_string(lines, chr(10)), length(prompt) + 1) as suffix from g)
"""


def gen_frame(spark, sf_dir):
    d = E.generated_lines(taf_results(spark, sf_dir), out="lines")
    return d.withColumn("suffix", taf.suffix_after(F.array_join("lines", "\n"), F.col("prompt")))


@query("completion_suffix", GEN + "select rec_id, strategy, suffix from x")
def q_completion_suffix(spark, sf_dir):
    return gen_frame(spark, sf_dir).select("rec_id", "strategy", "suffix")


@query("next_word", GEN + """
, p as (select *, case when starts_with(suffix, ' ')
          then (case when strpos(substr(suffix, 2), ' ') = 0 then 0 else strpos(substr(suffix, 2), ' ') + 1 end)
          else strpos(suffix, ' ') end as pos from x)
select rec_id, strategy, case when pos = 0 then '' else substr(suffix, 1, pos - 1) end as next_word from p
""")
def q_next_word(spark, sf_dir):
    return gen_frame(spark, sf_dir).select("rec_id", "strategy", taf.next_word("suffix").alias("next_word"))


@query("next_line", GEN + "select rec_id, strategy, split_part(suffix, chr(10), 1) || chr(10) as next_line from x")
def q_next_line(spark, sf_dir):
    return gen_frame(spark, sf_dir).select("rec_id", "strategy", taf.next_line("suffix").alias("next_line"))


@query("all_upper", GEN + """
select rec_id, strategy, len(list_filter(lines, lambda l: not (upper(l) = l and lower(l) <> l))) = 0 as all_upper
from g
""")
def q_all_upper(spark, sf_dir):
    return gen_frame(spark, sf_dir).select("rec_id", "strategy", taf.all_upper("lines").alias("all_upper"))


@query("normalise_text", f"""
select conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l:
  case when regexp_matches(l, '^{JS_WS}') then regexp_replace(l, '^{JS_WS}+', '')
       else regexp_replace(l, '{JS_WS}{JS_WS}+$', '') end), lambda l: l <> ''), chr(10)) as normalised
from conversations
""")
def q_normalise_text(spark, sf_dir):
    # upper=False: DuckDB's upper() does not expand characters such as 'ß' as Java and JS do.
    c = load_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", taf.normalise_editor_text("text", upper=False).alias("normalised"))


@query("json_struct", RS + "select rec_id, strategy, prompt, completion from taf_results")
def q_json_struct(spark, sf_dir):
    schema = T.StructType([T.StructField("rec_id", T.LongType()), T.StructField("strategy", T.StringType()),
                           T.StructField("prompt", T.StringType()), T.StructField("completion", T.StringType())])
    d = taf_results(spark, sf_dir)
    j = d.select(F.to_json(F.struct("rec_id", "strategy", "prompt", "completion")).alias("json"))
    return j.select(F.from_json("json", schema).alias("r")).select("r.*")


# ---- scoring ------------------------------------------------------------------------------------
SCORE = GEN + """
, sc as (select *, string_split(prompt, chr(10))[-1] as last_line from g)
, sm as (select *, list_filter(lines, lambda l: starts_with(l, last_line)) as matches,
           contains(last_line, 'TS') as scored,
           len(list_filter(lines, lambda l: not (upper(l) = l and lower(l) <> l))) = 0 as upper_ok from sc)
"""


def score_frame(spark, sf_dir, variant="validate"):
    d = gen_frame(spark, sf_dir).withColumnsRenamed({"prompt": "prompt_text", "lines": "generated_text"})
    return E.score(d, variant=variant)


@query("score_validate", SCORE + """
select rec_id, strategy,
  cast(case when not scored then 0.0 when len(matches) = 1 then
    (case when contains(matches[1], 'CB') then 1.0 else -1.0 end) + (case when upper_ok then 1.0 else -1.0 end) end as double) as score,
  case when scored and len(matches) = 0 then 'no_line' when scored and len(matches) > 1 then 'many_lines' end as score_error
from sm
""")
def q_score_validate(spark, sf_dir):
    return score_frame(spark, sf_dir).select("rec_id", "strategy", "score", "score_error")


@query("score_penalty", SCORE + """
select rec_id, strategy,
  cast(case when not scored then 0.0 when len(matches) >= 1 then
    (case when contains(matches[1], 'CB') then 1.0 else -1.0 end) + (case when upper_ok then 1.0 else -5.0 end) end as double) as score,
  case when scored and len(matches) = 0 then 'no_line' end as score_error
from sm
""")
def q_score_penalty(spark, sf_dir):
    return score_frame(spark, sf_dir, "penalty").select("rec_id", "strategy", "score", "score_error")


@query("score_report", SCORE + """
select strategy, rec_id, prompt as prompt_text, lines as generated_text,
  cast(case when not scored then 0.0 when len(matches) = 1 then
    (case when contains(matches[1], 'CB') then 1.0 else -1.0 end) + (case when upper_ok then 1.0 else -1.0 end) end as double) as score
from sm order by score nulls first, strategy, rec_id
""")
def q_score_report(spark, sf_dir):
    d = score_frame(spark, sf_dir).select("strategy", "rec_id", "prompt_text", "generated_text", "score")
    return E.score_report(d)


@query("rank_scores", SCORE + """
select strategy, rec_id,
  cast(case when not scored then 0.0 when len(matches) >= 1 then
    (case when contains(matches[1], 'CB') then 1.0 else -1.0 end) + (case when upper_ok then 1.0 else -5.0 end) end as double) as score
from sm order by score nulls first, strategy, rec_id
""")
def q_rank_scores(spark, sf_dir):
    return E.score_report(score_frame(spark, sf_dir, "penalty").select("strategy", "rec_id", "score"))


# ---- strategies -------------------------------------------------------------------------------
def _sql_lit(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return f"'{v}'"
    return repr(v)


CATALOG_SQL = ("(select name, canonical, do_sample, cast(num_beams as integer) as num_beams, early_stopping, "
               "cast(no_repeat_ngram_size as integer) as no_repeat_ngram_size, cast(temperature as double) as temperature, "
               "cast(top_k as integer) as top_k, cast(top_p as double) as top_p from (values "
               + ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in S.STRATEGIES)
               + ") v(name, canonical, do_sample, num_beams, early_stopping, no_repeat_ngram_size, temperature, top_k, top_p))")
PARAMS = ", ".join(S.PARAM_FIELDS)
NAMES = [r[0] for r in S.STRATEGIES] + ["UNKNOWN_STRATEGY"]
_names_sql = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


@query("strategy_catalog", RS + f"""
select c.*, coalesce(u.n_results, 0) as n_results from {CATALOG_SQL} c
left join (select strategy, count(*) as n_results from taf_results group by strategy) u on u.strategy = c.name
""")
def q_strategy_catalog(spark, sf_dir):
    used = taf_results(spark, sf_dir).groupBy("strategy").agg(F.count(F.lit(1)).alias("n_results"))
    cat = S.strategy_catalog(spark)
    out = cat.join(used, cat.name == used.strategy, "left").drop("strategy")
    return out.fillna(0, ["n_results"])


def requests(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in NAMES])
    idx = (F.pmod(F.col("rec_id"), F.lit(len(NAMES))) + 1).cast("int")
    return taf_records(spark, sf_dir).select("rec_id", F.element_at(names, idx).alias("requested"))


_REQ = f"(select rec_id, {_names_sql}[(rec_id % {len(NAMES)}) + 1] as requested from taf_records)"


@query("resolve_strategy", duckdb_cte(["taf_records"]) + f"""
select r.rec_id, r.requested, c.canonical, {', '.join('c.' + f for f in S.PARAM_FIELDS)}
from {_REQ} r join {CATALOG_SQL} c on c.name = r.requested
""")
def q_resolve_strategy(spark, sf_dir):
    return S.resolve_strategy(requests(spark, sf_dir), S.strategy_catalog(spark))


@query("unknown_strategy", duckdb_cte(["taf_records"]) + f"""
select r.requested, r.rec_id from {_REQ} r anti join {CATALOG_SQL} c on c.name = r.requested
""")
def q_unknown_strategy(spark, sf_dir):
    return S.unknown_strategy(requests(spark, sf_dir), S.strategy_catalog(spark))


_canon_sql = "[" + ", ".join(f"'{n}'" for n in S.CANONICAL) + "]"


@query("assign_strategy", duckdb_cte(["taf_records"]) + f"""
select rec_id, {_canon_sql}[(cast('0x' || substr(md5('taffeta' || cast(rec_id as varchar)), 1, 7) as bigint)
   % {len(S.CANONICAL)}) + 1] as strategy from taf_records
""")
def q_assign_strategy(spark, sf_dir):
    return S.assign_strategy(taf_records(spark, sf_dir).select("rec_id"), "rec_id")


@query("prompt_grid", duckdb_cte(["taf_records"]) + f"""
select r.rec_id, c.name as strategy, {', '.join('c.' + f for f in S.PARAM_FIELDS)}
from taf_records r cross join (select * from {CATALOG_SQL} where name = canonical) c
""")
def q_prompt_grid(spark, sf_dir):
    return S.prompt_grid(taf_records(spark, sf_dir).select("rec_id"))


@query("attach_results", RR + f"""
select g.rec_id, g.name as strategy, t.completion
from (select rec_id, name from taf_records cross join (select name from {CATALOG_SQL} where name = canonical)) g
left join taf_results t on t.rec_id = g.rec_id and t.strategy = g.name
""")
def q_attach_results(spark, sf_dir):
    grid = S.prompt_grid(taf_records(spark, sf_dir).select("rec_id")).select("rec_id", "strategy")
    res = taf_results(spark, sf_dir).select("rec_id", "strategy", "completion")
    return grid.join(res, ["rec_id", "strategy"], "left")


_OVERRIDE = {"temperature": "cast(case when t.rec_id % 3 = 0 then 0.7 end as double)",
             "top_k": "cast(case when t.rec_id % 5 = 0 then 10 end as integer)"}


@query("override_params", RS + f"""
select t.rec_id, t.strategy, {', '.join(
    f"coalesce({_OVERRIDE[f]}, c.{f}) as {f}" if f in _OVERRIDE else f"c.{f}" for f in S.PARAM_FIELDS)}
from taf_results t join {CATALOG_SQL} c on c.name = t.strategy
""")
def q_override_params(spark, sf_dir):
    res = taf_results(spark, sf_dir).select("rec_id", "strategy")
    cat = F.broadcast(S.strategy_catalog(spark).select(F.col("name").alias("strategy"), S.params_col().alias("params")))
    kw = F.struct(*[
        (F.when(F.col("rec_id") % 3 == 0, F.lit(0.7)) if f == "temperature"
         else F.when(F.col("rec_id") % 5 == 0, F.lit(10)) if f == "top_k"
         else F.lit(None)).cast(S.PARAMS_TYPE[f].dataType).alias(f) for f in S.PARAM_FIELDS])
    d = S.override_params(res.join(cat, "strategy").withColumn("kwargs", kw))
    return d.select("rec_id", "strategy", "merged.*")


# ---- unions -------------------------------------------------------------------------------------
@query("union_results", RS + """
select prompt, completion, strategy, null::varchar as model from taf_results where strategy in ('GREEDY', 'BEAM_SEARCH')
union all
select prompt, completion, strategy, 'gpt2-taf-base1' as model from taf_results where strategy not in ('GREEDY', 'BEAM_SEARCH')
""")
def q_union_results(spark, sf_dir):
    r = taf_results(spark, sf_dir).select("prompt", "completion", "strategy")
    first = F.col("strategy").isin("GREEDY", "BEAM_SEARCH")
    a = r.where(first)
    b = r.where(~first).withColumn("model", F.lit("gpt2-taf-base1"))
    return a.unionByName(b, allowMissingColumns=True)


_prompts_sql = ", ".join("('" + p + "')" for p in PROMPT_EXAMPLES)


@query("union_prompts", RS + f"""
select prompt, 'config' as source from (values {_prompts_sql}) v(prompt)
union all select prompt, 'extra' as source from taf_results
""")
def q_union_prompts(spark, sf_dir):
    cfg = spark.createDataFrame([(p,) for p in PROMPT_EXAMPLES], "prompt string").withColumn("source", F.lit("config"))
    extra = taf_results(spark, sf_dir).select("prompt", F.lit("extra").alias("source"))
    return cfg.unionAll(extra)
