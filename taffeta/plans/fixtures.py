"""Derived TAF fixtures.

Both are pure SQL over ``events`` that runs unchanged in Spark SQL and DuckDB, so every
TAF query grows with the events table and its oracle sees exactly the same input.
``taf_records`` is one forecast per event; ``taf_results`` is four strategy results per event.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from taffeta.session import scratch_path
from taffeta.sources.tables import load_table, spread

_MATERIALISED: dict = {}

# The 18 stations of the reference corpus, in its order.
STATIONS = ("KADW,KBLV,KDAA,KDOV,KFAF,KFFO,KFTK,KGUS,KHOP,KLFI,KMTC,KMUI,KOFF,KRDR,KWRI,"
            "PABI,PAFB,PASY")

TAF_RECORDS_SQL = """
select event_id as rec_id, icao, tx, tn, cor,
 concat('TAF ', case when event_type='error' then 'AMD ' else '' end, cor, icao, ' ', dd, hh, '00Z ', dd, hh, '/', dd, '24 ',
  lpad(cast(event_id*7%36 as varchar(9)),2,'0'), '0', lpad(cast(event_id%25+3 as varchar(9)),2,'0'),
  case when event_id%5=0 then 'G35' else '' end, 'KT 9999 ',
  case when event_id%4=0 then '-TSRA BKN020CB' else 'SCT030' end,
  ' QNH2992INS BECMG ', dd, '12/', dd, '13 VRB06KT 9999 OVC015',
  case when event_id%31=0 then '' else concat(' TX', tx, '/', dd, '20Z TN', tn, '/', dd, '11Z') end) as text
from (select event_id, event_type, case when event_id%50=0 then 'COR ' else '' end as cor,
  split_part('__STATIONS__', ',', cast(user_id%18+1 as int)) as icao,
  lpad(cast(extract(day from ts) as varchar(9)),2,'0') as dd, lpad(cast(extract(hour from ts) as varchar(9)),2,'0') as hh,
  concat(case when a<0 then 'M' else '' end, lpad(cast(abs(a) as varchar(9)),2,'0')) as tx,
  concat(case when a-b<0 then 'M' else '' end, lpad(cast(abs(a-b) as varchar(9)),2,'0')) as tn
  from (select *, cast(event_id*13%40 as int)-8 as a, cast(event_id*3%11 as int)+1 as b from {events}) e) x
""".replace("__STATIONS__", STATIONS)

TAF_RESULTS_SQL = """
select rec_id, strategy,
 concat('TAF [TX', tx, ' TN', tn, '] ', icao, ' 010000Z 0100/0124 ', case when rec_id%4=0 then '-TSRA' else '9999' end,
   case when rec_id%53=0 then ' VCSH SCT012' else '' end) as prompt,
 case when (rec_id+sid)%11=0 then ' BKN020 QNH2992INS'
      else concat(case when (rec_id+sid)%6=0 then ' bkn020' when (rec_id+sid)%3=0 then ' BKN020' else ' BKN020CB' end,
        ' QNH2992INS BECMG 0112/0113 VRB06KT 9999 OVC015 TX', ctx, '/0120Z TN', tn, '/0111Z') end as completion
from (select event_id as rec_id, sid, strategy,
  split_part('__STATIONS__', ',', cast(user_id%18+1 as int)) as icao,
  concat(case when a<0 then 'M' else '' end, lpad(cast(abs(a) as varchar(9)),2,'0')) as tx,
  concat(case when a-b<0 then 'M' else '' end, lpad(cast(abs(a-b) as varchar(9)),2,'0')) as tn,
  concat(case when a+d<0 then 'M' else '' end, lpad(cast(abs(a+d) as varchar(9)),2,'0')) as ctx
 from (select e.*, s.*, cast(event_id*13%40 as int)-8 as a, cast(event_id*3%11 as int)+1 as b, case when event_id%97=0 then 25 else cast((event_id+sid)%5 as int) end as d
       from {events} e cross join (values (0,'GREEDY'),(1,'BEAM_SEARCH'),(2,'TOP_K50'),(3,'TOP_P92')) s(sid,strategy)) y) x
""".replace("__STATIONS__", STATIONS)


def _materialised(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    """Build a derived fixture once per application and input folder, written as Parquet below
    the shared checkpoint folder; queries then read it like any stored table (so a pushed-down
    filter reads a column instead of re-deriving the text)."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    path = _MATERIALISED.get(key)
    if path is None:
        path = scratch_path(spark, f"fixture-{name}")
        df = spark.sql(sql, events=load_table(spark, sf_dir, "events", spread_small=False))
        spread(df).write.parquet(path)
        _MATERIALISED[key] = path
    return spark.read.parquet(path)


def taf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialised(spark, sf_dir, "taf_records", TAF_RECORDS_SQL)


# Spark form of the same fixture: the fixed four-way fan-out is a generator over a literal array
# (no join); DuckDB's oracle keeps the cross join with VALUES. The oracle checks prove both equal.
TAF_RESULTS_SPARK_SQL = TAF_RESULTS_SQL.replace(
    "from {events} e cross join (values (0,'GREEDY'),(1,'BEAM_SEARCH'),(2,'TOP_K50'),(3,'TOP_P92')) s(sid,strategy)",
    "from {events} e lateral view inline(array(struct(0,'GREEDY'),struct(1,'BEAM_SEARCH'),"
    "struct(2,'TOP_K50'),struct(3,'TOP_P92'))) s as sid, strategy")
assert TAF_RESULTS_SPARK_SQL != TAF_RESULTS_SQL


def taf_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialised(spark, sf_dir, "taf_results", TAF_RESULTS_SPARK_SQL)


def duckdb_cte(names=("taf_records", "taf_results")) -> str:
    """``WITH`` clause defining the fixtures over DuckDB's ``events`` view."""
    parts = []
    if "taf_records" in names:
        parts.append("taf_records as (" + TAF_RECORDS_SQL.replace("{events}", "events") + ")")
    if "taf_results" in names:
        parts.append("taf_results as (" + TAF_RESULTS_SQL.replace("{events}", "events") + ")")
    return "with " + ",\n".join(parts) + "\n"


# The configured TAF prompt examples of the main model, in their order.
PROMPT_EXAMPLES = (
    "TAF [TX20 TN13] AMD KDAA 251400Z 2514/2616 VRB03KT 9000 BR",
    "TAF [TX08 TN02] AMD KHOP 151230Z 1512/1614 23005KT 4800 -SHRA BR OVC004",
    "TAF [TXM03 TNM08] AMD KRDR 141452Z 1414/1516",
    "TAF [TX26 TN15] KFTK 041900Z 0419/0601 18012G22KT 9999",
    "TAF [TX21 TN14] KFAF 031000Z 0310/0416 04006KT 9999 BKN007",
    "TAF [TX19 TN09] AMD KFTK 011405Z 0114/0217 24005KT 9999",
    "TAF [TX05 TN00] AMD KFTK 151405Z 1514/1618 12006KT 9999 -DZ",
    "TAF [TX21 TN06] AMD KADW 130515Z 1305/1407 29015G25KT 9999",
    "TAF [TX14 TN02] KFAF 151900Z 1519/1701 13009KT 9999 OVC020",
    "TAF [TX04 TNM03] KFFO 130302Z 1303/1409 28009KT 9000 -SN BKN009 OVC020 620098",
    "TAF [TX02 TNM03] AMD KFFO 121425Z 1214/1317 29009KT 6000",
    "TAF [TX20 TN11] KMUI 311900Z 3119/0201 VRB06KT 9999 FEW015 OVC025",
    "TAF [TX20 TN08] KMUI 021100Z 0211/0317 VRB06KT 9999 SCT015",
    "TAF [TX02 TNM03] KFFO 121100Z 1211/1317 29012KT 9999 BKN022",
    "TAF [TX01 TN00] AMD KMTC 152130Z 1521/1702 VRB06KT 2800 -SN OVC015",
    "TAF [TX16 TN02] AMD KFFO 111351Z 1113/1217 11006KT 6000 -RA BR",
    "TAF [TXM03 TNM07] KRDR 101000Z 1010/1116 02020G30KT 9999",
    "TAF [TX11 TN00] AMD KADW 161523Z 1615/1715 29012G18KT 9999 BKN030 BKN200 510013",
    "TAF [TX16 TN12] KLFI 090000Z 0900/1006 04012G18KT 9999 SKC",
    "TAF [TXM07 TNM09] PABI 161400Z 1614/1720 10015G25KT 9999 FEW030 510043",
    "TAF [TX03 TNM03] KBLV 160000Z 1600/1706 30009KT 9999 OVC020",
    "TAF [TXM04 TNM13] KRDR 151000Z 1510/1616 35006KT 9999",
    "TAF [TXM13 TNM24] AMD PAFB 011013Z 0110/0212 VRB03KT 9999",
    "TAF [TX17 TN06] KGUS 061300Z 0613/0719 18009KT FEW150",
    "TAF [TX22 TN13] AMD KWRI 120435Z 1204/1308 18015G25KT 9999 VCSH SCT012",
    "TAF [TX06 TN03] PASY 101400Z 1014/1120 02030G40KT 9000 -SHRA SCT003 OVC010",
    "TAF [TXM01 TNM07] AMD KRDR 092100Z 0921/1024 36010G20KT 8000 -SN OVC009",
    "TAF [TXM08 TNM20] PAFB 160700Z 1607/1713 06010KT",
    "TAF [TX18 TN06] KADW 100100Z 1001/1107 08006KT 9999 FEW200",
    "TAF [TX11 TN03] AMD KDOV 161144Z 1611/1714",
    "TAF [TX24 TN09] KLFI 121800Z 1218/1324 25009KT 9999",
    "TAF [TX09 TNM01] KWRI 140200Z 1402/1508 31009KT 9999 SKC QNH3005INS",
    "TAF [TXM06 TNM12] AMD KRDR 150742Z 1507/1608",
    "TAF [TX19 TN13] KBLV 100000Z 1000/1106 14009KT 9999 FEW050",
    "TAF [TX19 TN09] AMD KFTK 011530Z 0115/0217",
    "TAF [TX24 TN19] AMD KLFI 111128Z 1111/1215",
    "TAF [TXM13 TNM24] PAFB 010600Z 0106/0212 VRB03KT 9999 BKN040 BKN100",
    "TAF [TX26 TN07] KDAA 071200Z 0712/0818 VRB06KT",
    "TAF [TX02 TNM04] AMD KBLV 161934Z 1619/1722 28012G20KT 9999 SCT030 BKN050 BKN080",
    "TAF [TXM09 TNM13] PAFB 151500Z 1515/1621 VRB03KT 8000 BR OVC006",
)
