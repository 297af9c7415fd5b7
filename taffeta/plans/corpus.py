"""Corpus queries: segmentation, metadata, templating, prefix pairs, TAF token splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from taffeta.functions import taf
from taffeta.functions.generators import posexplode_rows
from taffeta.operators import metadata as M
from taffeta.operators import prefixes as G
from taffeta.operators.segment import segment_records
from taffeta.plans.fixtures import STATIONS, duckdb_cte, taf_records, taf_results
from taffeta.plans.registry import query
from taffeta.plans.sqlparts import extract, split_ws, strip
from taffeta.sources.tables import load_table

R = duckdb_cte(["taf_records"])
RS = duckdb_cte(["taf_results"])
RR = duckdb_cte()
TEMPS = taf.METADATA_TEMPS


# ---- flagship: records -> metadata -> template -> prefix pairs -> distinct (M1 M3 M4 M5 G1 A1)
def flagship(spark, sf_dir):
    recs = M.template_records(taf_records(spark, sf_dir))
    return G.prefix_pairs(recs, "templated")


PAIRS_BODY = f"""
, m as (select text, {extract('text', TEMPS, 1)} tx, {extract('text', TEMPS, 2)} tn from taf_records),
w as (select {split_ws("'TAF [' || tx || ' ' || tn || '] ' || replace(text, 'TAF ', '')")} as w
      from m where tx is not null and tn is not null),
c as (select w, unnest(range(1, len(w))) as i from w),
pairs as (select distinct '<|bos|>' || array_to_string(w[1:i], ' ') || ' ' as prompt,
       array_to_string(w[i+1:], ' ') || '<|eos|>' as completion from c)
"""
PAIRS_CTE = R + PAIRS_BODY

query("prefix_pairs", PAIRS_CTE + "select prompt, completion from pairs")(flagship)


@query("segment_records", f"""
with p as (select doc_id, unnest(regexp_split_to_array(text, '\\n+#+\\n+')) as raw,
                  unnest(range(0, len(regexp_split_to_array(text, '\\n+#+\\n+')))) as pos from documents)
select doc_id, cast(pos as integer) as pos, {strip('raw')} as text from p
""")
def q_segment_records(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    return segment_records(docs, "text", keep=("doc_id",))


@query("extract_temps", R + f"""
select rec_id, {extract('text', TEMPS, 1)} as tx, {extract('text', TEMPS, 2)} as tn from taf_records
""")
def q_extract_temps(spark, sf_dir):
    return M.extract_temps(taf_records(spark, sf_dir).select("rec_id", "text")).drop("text")


@query("extract_custom", R + f"""
select rec_id, {extract('text', '(?:(?:TX)(M?\\d{2}).+(?:TN)(M?\\d{2}))', 1)} as TX,
       {extract('text', '(?:(?:TX)(M?\\d{2}).+(?:TN)(M?\\d{2}))', 2)} as TN,
       {extract('text', '(?:(TXM?/\\d{2}).+(TNM?/\\d{2}))$', 1)} as cfg_0,
       {extract('text', '(?:(TXM?/\\d{2}).+(TNM?/\\d{2}))$', 2)} as cfg_1
from taf_records
""")
def q_extract_custom(spark, sf_dir):
    d = taf_records(spark, sf_dir).select("rec_id", "text")
    d = M.extract_custom(d, taf.TEMPERATURE_NAMED)
    cfg = taf.extract_named("text", taf.CONFIG_METADATA_PATTERN)
    return d.withColumns({f"cfg_{k}": v for k, v in cfg.items()}).drop("text")


@query("extract_callback", R + """
select rec_id, regexp_extract(text, 'Z (\\d{3}|VRB)(\\d{2})(G\\d{2})?KT', 1) as wind,
  try_cast(regexp_extract(text, 'Z (\\d{3}|VRB)(\\d{2})(G\\d{2})?KT', 2) as integer) as speed, contains(text, 'G35KT') as gusts from taf_records
""")
def q_extract_callback(spark, sf_dir):
    """The caller's own extractor in place of a pattern."""
    def wind(text):
        group = [F.regexp_extract(text, r"Z (\d{3}|VRB)(\d{2})(G\d{2})?KT", i) for i in (1, 2)]
        return F.struct(group[0].alias("wind"), group[1].try_cast("int").alias("speed"), F.contains(text, F.lit("G35KT")).alias("gusts"))

    return M.extract_custom(taf_records(spark, sf_dir).select("rec_id", "text"), "", extractor=wind).drop("text")


@query("request_prompts", f"""
select doc_id, line, {strip('raw')} as prompt from (select doc_id, unnest(string_split(text, chr(10))) as raw,
  cast(unnest(range(0, len(string_split(text, chr(10))))) as integer) as line from documents) where {strip('raw')} <> ''
""")
def q_request_prompts(spark, sf_dir):
    """Each line of each document as typed text."""
    docs = load_table(spark, sf_dir, "documents")
    lines = posexplode_rows(docs, ["doc_id"], F.split("text", "\n", -1), "line", "raw")
    return G.request_prompts(lines, "raw").drop("raw")


@query("build_header", R + f"""
select rec_id, {extract('text', TEMPS, 1)} || ' ' || {extract('text', TEMPS, 2)} as header from taf_records
where {extract('text', TEMPS, 1)} is not null
""")
def q_build_header(spark, sf_dir):
    d = M.build_header(M.extract_temps(taf_records(spark, sf_dir).select("rec_id", "text")))
    return d.select("rec_id", "header")


@query("apply_template", R + f"""
select rec_id, 'TAF [' || {extract('text', TEMPS, 1)} || ' ' || {extract('text', TEMPS, 2)} || '] '
       || replace(text, 'TAF ', '') as templated from taf_records
where {extract('text', TEMPS, 1)} is not null
""")
def q_apply_template(spark, sf_dir):
    return M.template_records(taf_records(spark, sf_dir).select("rec_id", "text")).select("rec_id", "templated")


@query("extract_station", RS + f"""
select rec_id, strategy, {extract('prompt', taf.STATION_AS_IS, 1)} as icao,
       {extract('prompt', taf.STATION_FIRST, 1)} as icao_first from taf_results
""")
def q_extract_station(spark, sf_dir):
    d = taf_results(spark, sf_dir).select("rec_id", "strategy", "prompt")
    d = M.extract_station(d, "prompt", "first").withColumnRenamed("icao", "icao_first")
    return M.extract_station(d, "prompt", "as_is").drop("prompt")


@query("extract_temps_strict", R + f"""
select rec_id, {extract('text', '\\sTX?(M?\\d{2})\\/\\d{4}Z\\sTN?(M?\\d{2})\\/\\d{4}Z$', 1)} as maximum_temperature,
       {extract('text', '\\sTX?(M?\\d{2})\\/\\d{4}Z\\sTN?(M?\\d{2})\\/\\d{4}Z$', 2)} as minimum_temperature,
       regexp_matches(text, '{taf.TEMPERATURE_GROUP}') as has_temperature_group from taf_records
""")
def q_extract_temps_strict(spark, sf_dir):
    return M.extract_temps_strict(taf_records(spark, sf_dir).select("rec_id", "text")).drop("text")


@query("filter_corrections", R + """
select rec_id, text from taf_records where not regexp_matches(text, '\\bCOR\\b')
""")
def q_filter_corrections(spark, sf_dir):
    return M.filter_corrections(taf_records(spark, sf_dir).select("rec_id", "text"))


CAP_STATIONS = STATIONS.split(",")
_station_list = ", ".join(f"'{s}'" for s in CAP_STATIONS)


@query("cap_per_station", R + f"""
select rec_id, icao from (
  select rec_id, icao, row_number() over (partition by icao order by md5('taffeta' || cast(rec_id as varchar)), rec_id) as r
  from taf_records where icao in ({_station_list})) where r <= 100
""")
def q_cap_per_station(spark, sf_dir):
    d = taf_records(spark, sf_dir).select("rec_id", "icao")
    return M.cap_per_station(d, CAP_STATIONS, cap=100)


@query("tokenise", f"""
with t as (select doc_id, {split_ws('text')} as w from documents)
select doc_id, cast(pos - 1 as integer) as pos, w[pos] as token
from (select doc_id, w, unnest(range(1, len(w) + 1)) as pos from t)
""")
def q_tokenise(spark, sf_dir):
    d = G.tokenise(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return posexplode_rows(d, ["doc_id"], F.col("tokens"), "pos", "token")


def _wind_sql(x):
    x = f"regexp_replace({x}, '(\\s)(\\d{{3}}|VRB)(\\d{{2,3}}(KT|G\\d{{2,3}}KT))', '\\1\\2 \\3', 'g')"
    x = f"regexp_replace({x}, 'G(\\d{{2,3}})KT(\\s)', ' G \\1KT\\2', 'g')"
    return f"regexp_replace({x}, 'KT(\\s)', ' KT\\1', 'g')"


def _cloud_sql(x):
    x = f"regexp_replace({x}, '(FEW|SCT|BKN|OVC)(\\d{{3}})', '\\1 \\2', 'g')"
    return f"regexp_replace({x}, '(FEW|SCT|BKN|OVC) (\\d{{3}})CB', '\\1 \\2 CB', 'g')"


def _legacy_sql(x):
    x = f"regexp_replace({x}, '(\\s)(\\d{{3}})(\\d{{2}})', '\\1\\2 \\3', 'g')"
    x = f"regexp_replace({x}, '(FEW|SCT|BKN|OVC)(\\d{{3}})CB', '\\1\\2 CB', 'g')"
    x = f"regexp_replace({x}, 'G(\\d{{2,3}})KT', ' G\\1KT', 'g')"
    x = f"regexp_replace({x}, 'KT', ' KT', 'g')"
    return f"regexp_replace({x}, '(FEW|SCT|BKN|OVC)', '\\1 ', 'g')"


query("split_wind", R + f"select rec_id, {_wind_sql('text')} as split from taf_records")(
    lambda spark, sf_dir: taf_records(spark, sf_dir).select(
        "rec_id", taf.split_tokens("text", "wind").alias("split")))

query("split_cloud", R + f"select rec_id, {_cloud_sql('text')} as split from taf_records")(
    lambda spark, sf_dir: taf_records(spark, sf_dir).select(
        "rec_id", taf.split_tokens("text", "cloud").alias("split")))

query("split_taf_tokens", R + f"""
select rec_id, {_cloud_sql(_wind_sql('text'))} as split_all, {_legacy_sql('text')} as split_legacy from taf_records
""")(lambda spark, sf_dir: taf_records(spark, sf_dir).select(
    "rec_id", taf.split_tokens("text", "all").alias("split_all"),
    taf.split_tokens("text", "legacy").alias("split_legacy")))


def _change_groups_sql(x):
    marked = f"regexp_replace(replace({x}, chr(10), ''), '(BECMG|TEMPO)', chr(1) || '\\1', 'g')"
    return (f"list_transform(list_filter(string_split({marked}, chr(1)), lambda s: s <> ''), "
            f"lambda s: {strip('s')})")


@query("split_change_groups", RS + f"""
with l as (select rec_id, strategy, {_change_groups_sql('prompt || completion')} as lines from taf_results)
select rec_id, strategy, cast(pos - 1 as integer) as pos, lines[pos] as line
from (select *, unnest(range(1, len(lines) + 1)) as pos from l)
""".replace(RS, RS, 1).replace("with l as", ", l as", 1))
def q_split_change_groups(spark, sf_dir):
    d = taf_results(spark, sf_dir)
    return posexplode_rows(d, ["rec_id", "strategy"], taf.change_groups(F.concat("prompt", "completion")),
                           "pos", "line")


@query("dedup_pairs", """
select distinct u.text as prompt, a.text as completion
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'
""")
def q_dedup_pairs(spark, sf_dir):
    c = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return G.dedup_pairs(u.join(a, ["conv_id", "turn"]).select("prompt", "completion"))


@query("prefix_cuts", f"""
with t as (select doc_id, len({split_ws('text')}) as n_tokens from documents)
select doc_id, n_tokens, cut from (select doc_id, n_tokens, unnest(range(1, n_tokens)) as cut from t)
""")
def q_prefix_cuts(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return G.prefix_cuts(d, "doc_id", "text").select("doc_id", F.col("n_tokens").cast("bigint"),
                                                     F.col("cut").cast("bigint"))
