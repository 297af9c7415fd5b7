"""Production queries of the operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taffeta.llm.batches import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_fingerprints")
def op1(spark, sf_dir):
    from taffeta.llm.fingerprints import with_edited
    return with_edited(spark, table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def op10(spark, sf_dir):
    import public_tokenizers as P
    from taffeta.llm.bpe import digests, encode
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).drop("text"))


@query("op6_secrets")
def op6(spark, sf_dir):
    from taffeta.llm.secrets import scan, summary
    return summary(scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


@query("op8_licenses")
def op8(spark, sf_dir):
    from taffeta.llm.licenses import scan, summary
    return summary(scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


@query("op9_mixing")
def op9(spark, sf_dir):
    from taffeta.llm.mixing import copies, narrow
    out = copies(narrow(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query("op4_minhash")
def op4(spark, sf_dir):
    from taffeta.llm.minhash import near_duplicates
    return near_duplicates(spark, table(spark, sf_dir, "documents"), words=2).drop("rid")


@query("op7_line_dedup")
def op7(spark, sf_dir):
    from taffeta.llm.lines import dedup_lines
    return dedup_lines(spark, table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    from taffeta.llm.toxicity import score, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         (F.col("restored") != F.coalesce("text", F.lit(""))).alias("restored"))


@query("op3_language")
def op3(spark, sf_dir):
    from taffeta.llm.language import identify
    return identify(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op5_neighbours")
def op5(spark, sf_dir):
    from taffeta.llm.neighbours import search
    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op12_search"] = r"""
with t as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
sizes as (select doc_id, len(ts) as n from t where len(ts) > 0),
totals as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from t) group by doc_id, term),
df as (select term, count(*) as df from tf group by term),
asked as (select item_id, term, count(*) as times from (select item_id,
            unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by item_id, term),
scored as (select item_id, doc_id, sum(times * cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double)) as bigint)
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::bigint as score
           from asked join df using (term) join tf using (term) join sizes using (doc_id), totals group by item_id, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *,
  row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 10
"""


@query("op12_search")
def op12(spark, sf_dir):
    from taffeta.llm.search import search
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_spans")
def op13(spark, sf_dir):
    from taffeta.llm.spans import dedup_spans
    return dedup_spans(spark, table(spark, sf_dir, "documents"), texts=False)


ORACLES["op11_phrases"] = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
grams as (select lang, size, array_to_string(ws[i:i + size - 1], ' ') as phrase
    from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from w, range(1, 6) s(size))),
f as (select lang, phrase, size, count(*) as a from grams group by all having count(*) >= 100),
sizes as (select lang, sum(len(ws))::bigint as n from w group by lang),
kept as (select * from f where size > 1 and not exists (select 1 from f g where g.lang = f.lang and g.size > f.size and g.a >= f.a
    and contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))),
cuts as (select *, string_split(phrase, ' ') as ws from (select *, unnest(range(1, size)) as k from kept)),
scored as (select c.lang, c.phrase, c.k, c.a, l.a as l, r.a as r, n, (1000::hugeint * c.a * n) // (l.a::hugeint * r.a) as score
    from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(ws[1:k], ' ')
    join f r on r.lang = c.lang and r.phrase = array_to_string(ws[k + 1:], ' ') join sizes on sizes.lang = c.lang),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from (select *,
    row_number() over (partition by lang order by score desc, a desc, phrase) as rank from weakest) where rank <= 2000
"""


@query("op11_phrases")
def op11(spark, sf_dir):
    from taffeta.llm.phrases import collocations
    return collocations(spark, table(spark, sf_dir, "documents"))
