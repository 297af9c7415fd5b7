"""Token, vocabulary and batch queries (K1-K9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from taffeta.functions.generators import explode_rows

from taffeta.functions import taf
from taffeta.functions.text import py_split_ws
from taffeta.operators import metadata as M
from taffeta.operators import tokens as K
from taffeta.plans.analysis import change_groups_sql
from taffeta.plans.corpus import PAIRS_CTE
from taffeta.plans.fixtures import taf_records
from taffeta.plans.registry import query
from taffeta.plans.sqlparts import split_ws
from taffeta.session import drop_shuffles, materialise
from taffeta.sources.tables import load_table

N_RES = len(K.RESERVED)
_res_list = ", ".join(f"'{t}'" for t in K.RESERVED)
_res_values = ", ".join(f"('{t}', {i})" for i, t in enumerate(K.RESERVED))


def vocab_sql(tokens_query: str) -> str:
    """SQL vocabulary over a query yielding a ``token`` column."""
    return f"""(select token, cast(row_number() over (order by cnt desc, token) + {N_RES - 1} as bigint) as id,
        cnt as count from (select token, count(*) as cnt from ({tokens_query}) where token not in ({_res_list})
        group by token)
     union all select token, cast(id as bigint) as id, null::bigint as count from (values {_res_values}) r(token, id))"""


DOC_VOCAB = vocab_sql(f"select unnest({split_ws('text')}) as token from documents")
DOCS = f"""
with vocab as {DOC_VOCAB},
t as (select doc_id, w[pos] as token, pos from (select doc_id, w, unnest(range(1, len(w) + 1)) as pos
      from (select doc_id, {split_ws('text')} as w from documents))),
enc as (select d.doc_id, coalesce(list(v.id order by t.pos) filter (where t.pos is not null), []) as ids
        from documents d left join t on t.doc_id = d.doc_id left join vocab v on v.token = t.token group by d.doc_id)
"""


def doc_tokens(spark, sf_dir):
    return load_table(spark, sf_dir, "documents").select("doc_id", py_split_ws("text").alias("tokens"))


def doc_vocab(spark, sf_dir):
    return K.build_vocab(explode_rows(doc_tokens(spark, sf_dir), [], F.col("tokens"), "token"))


def doc_ids(spark, sf_dir):
    return K.encode(doc_tokens(spark, sf_dir), ["doc_id"], doc_vocab(spark, sf_dir))


@query("build_vocab", f"select * from {DOC_VOCAB}")
def q_build_vocab(spark, sf_dir):
    return doc_vocab(spark, sf_dir)


@query("encode_tokens", DOCS + "select doc_id, ids from enc")
def q_encode_tokens(spark, sf_dir):
    return doc_ids(spark, sf_dir)


@query("truncate_ids", DOCS + "select doc_id, cast(len(ids) as integer) as n_ids, ids[1:256] as ids from enc")
def q_truncate_ids(spark, sf_dir):
    d = doc_ids(spark, sf_dir)
    return d.select("doc_id", F.size("ids").alias("n_ids"), K.truncate(F.col("ids")).alias("ids"))


@query("decode_tokens", DOCS + f"""
, dec as (select t.doc_id, string_agg(v.token, ' ' order by t.pos) as text
          from t left join vocab v on v.token = t.token where v.token not in ({", ".join(f"'{x}'" for x in K.SPECIALS)})
          group by t.doc_id),
every as (select d.doc_id, coalesce(dec.text, '') as text from documents d left join dec on dec.doc_id = d.doc_id)
select doc_id, text, {change_groups_sql('text')} as lines from every
""")
def q_decode_tokens(spark, sf_dir):
    vocab = materialise(doc_vocab(spark, sf_dir), "doc-vocab")  # read by the encoding and the decoding
    d = K.decode(K.encode(doc_tokens(spark, sf_dir), ["doc_id"], vocab), ["doc_id"], vocab)
    return d.withColumn("lines", taf.change_groups(F.col("text")))


# ---- TAF pairs: encode once per distinct record, slice per pair ---------------------------------
_spec = "(<\\|pad\\|>|<\\|bos\\|>|<\\|eos\\|>)"


def _tok_sql(x):
    return split_ws(f"regexp_replace({x}, '{_spec}', ' \\1 ', 'g')")


PAIR_ENC = PAIRS_CTE + f"""
, norms as (select distinct array_to_string(w, ' ') as norm from w where len(w) > 1),
tvocab as {vocab_sql("select unnest(string_split(norm, ' ')) as token from norms")},
pt as (select prompt, completion, 'p' as side, x[pos] as token, pos from
        (select prompt, completion, x, unnest(range(1, len(x) + 1)) as pos from (select prompt, completion, {_tok_sql('prompt')} as x from pairs))
       union all
       select prompt, completion, 'c' as side, x[pos] as token, pos from
        (select prompt, completion, x, unnest(range(1, len(x) + 1)) as pos from (select prompt, completion, {_tok_sql('completion')} as x from pairs))),
enc as (select prompt, completion, list(v.id order by pos) filter (where side = 'p') as prompt_ids,
               list(v.id order by pos) filter (where side = 'c') as completion_ids
        from pt left join tvocab v on v.token = pt.token group by prompt, completion),
b as (select *, (row_number() over (order by md5(concat_ws(chr(1), 'taffeta', prompt, completion))) - 1) // 8 as batch from enc),
bm as (select batch, max(len(prompt_ids)) as mx from b group by batch)
"""


def taf_ids(spark, sf_dir):
    """(norm, ids, _n) of every distinct record."""
    recs = M.template_records(taf_records(spark, sf_dir))
    # the distinct records are stored before the test on their tokens, which would be pushed below the de-dup
    norm = recs.select(F.array_join(py_split_ws("templated"), " ").alias("norm")).dropDuplicates(["norm"])
    norm = materialise(norm, "taf-norm")  # read by the vocabulary and by the encoding
    norm = norm.withColumn("w", F.split("norm", " ")).where(F.size("w") > 1)
    vocab = K.build_vocab(explode_rows(norm, [], F.col("w"), "token"))
    seq = norm.select("norm", F.concat(F.array(F.lit(taf.BOS)), "w", F.array(F.lit(taf.EOS))).alias("tokens"))
    enc = K.encode(seq, ["norm"], vocab, "tokens", "ids")
    return enc.withColumn("_n", F.size("ids") - 2)  # tokens without BOS/EOS


def _cut_texts():
    cut = F.expr("length(substring_index(norm, ' ', _i))")
    return (F.concat(F.lit(taf.BOS), F.substring("norm", F.lit(1), cut), F.lit(" ")),
            F.concat(F.substring("norm", cut + 2, F.lit(1 << 30)), F.lit(taf.EOS)))


def _pair_columns(*more):
    prompt, completion = _cut_texts()
    return (prompt.alias("prompt"), completion.alias("completion"),
            F.slice("ids", F.lit(1), F.col("_i") + 1).alias("prompt_ids"),
            F.slice("ids", F.col("_i") + 2, F.col("_n") - F.col("_i") + 1).alias("completion_ids"), *more)


def taf_pair_ids(spark, sf_dir):
    """(prompt, completion, prompt_ids, completion_ids) for every distinct prefix pair."""
    x = explode_rows(taf_ids(spark, sf_dir), ["norm", "ids", "_n"], F.sequence(F.lit(1), F.col("_n") - 1), "_i")
    return x.select(*_pair_columns())


def taf_batches(spark, sf_dir, multiple=None):
    """The pairs with their ``batch`` and its ``target`` length. A cut is sorted as its hash, its record's number
    and its place; texts and ids are cut out of the stored records at the end."""
    recs = materialise(taf_ids(spark, sf_dir).withColumn("_rec", F.monotonically_increasing_id()), "taf-ids")
    drop_shuffles(spark)
    cuts = explode_rows(recs, ["_rec", "norm", "_n"], F.sequence(F.lit(1), F.col("_n") - 1), "_i")
    hashed = F.unhex(F.md5(F.concat_ws("\u0001", F.lit("taffeta"), *_cut_texts())))
    cuts = cuts.select("_rec", "_i", "_n", hashed.alias("_h"))
    cuts = K.batch_cuts(cuts, ["_h"], {"_i + 1": "target", "_n - _i + 1": "completion_target"}, multiple=multiple)
    cuts = cuts.select("_rec", "_i", "batch", "target", "completion_target")
    return K.with_cuts(recs, cuts, "_rec").select(*_pair_columns("batch", "target", "completion_target"))


def _padded(d, side):
    ids, target = F.col("prompt_ids"), F.col("target")
    return d.select("prompt", "completion", "batch", K.pad_to(ids, target, side).alias("padded"),
                    K.mask_for(ids, target, side).alias("attention_mask"))


@query("encode_pair", PAIR_ENC + "select prompt, completion, prompt_ids, completion_ids from enc")
def q_encode_pair(spark, sf_dir):
    return taf_pair_ids(spark, sf_dir)


@query("make_batches", PAIR_ENC + "select prompt, completion, batch from b")
def q_make_batches(spark, sf_dir):
    return taf_batches(spark, sf_dir).select("prompt", "completion", "batch")


def _pad_sql(target, side):
    fill = f"list_transform(range({target} - len(prompt_ids)), lambda x: 0::bigint)"
    zeros = f"list_transform(range({target} - len(prompt_ids)), lambda x: 0)"
    ones = "list_transform(prompt_ids, lambda x: 1)"
    if side == "left":
        return f"list_concat({fill}, prompt_ids) as padded, list_concat({zeros}, {ones}) as attention_mask"
    return f"list_concat(prompt_ids, {fill}) as padded, list_concat({ones}, {zeros}) as attention_mask"


@query("pad_batch", PAIR_ENC + f"select prompt, completion, b.batch, {_pad_sql('mx', 'left')} from b join bm using (batch)")
def q_pad_batch(spark, sf_dir):
    return _padded(taf_batches(spark, sf_dir), "left")


@query("pad_multiple", PAIR_ENC + f"""
select prompt, completion, b.batch, {_pad_sql('cast(ceil(mx / 20) * 20 as bigint)', 'right')} from b join bm using (batch)
""")
def q_pad_multiple(spark, sf_dir):
    return _padded(taf_batches(spark, sf_dir, K.PAD_MULTIPLE), "right")


def _pad_both_sql(ids, mx, side):
    fill, zeros = (f"list_transform(range({mx} - len({ids})), lambda x: {x})" for x in ("0::bigint", "0"))
    ones = f"list_transform({ids}, lambda x: 1)"
    a, m = (f"list_concat({fill}, {ids})", f"list_concat({zeros}, {ones})") if side == "left" else \
           (f"list_concat({ids}, {fill})", f"list_concat({ones}, {zeros})")
    return a, m


_p, _pm = _pad_both_sql("prompt_ids", "mx", "left")
_c, _cm = _pad_both_sql("completion_ids", "cx", "right")


@query("pad_pairs", PAIR_ENC + f"""
, bc as (select batch, max(len(completion_ids)) as cx from b group by batch)
select prompt, completion, b.batch, {_p} as prompt_padded, {_pm} as prompt_mask, {_c} as completion_padded, {_cm} as completion_mask
from b join bm using (batch) join bc using (batch)
""")
def q_pad_pairs(spark, sf_dir):
    """Prompts padded on the left, as for generation, and completions on the right, as for training."""
    d = taf_batches(spark, sf_dir)
    p, c = F.col("prompt_ids"), F.col("completion_ids")
    return d.select("prompt", "completion", "batch",
                    K.pad_to(p, F.col("target"), "left").alias("prompt_padded"), K.mask_for(p, F.col("target"), "left").alias("prompt_mask"),
                    K.pad_to(c, F.col("completion_target"), "right").alias("completion_padded"),
                    K.mask_for(c, F.col("completion_target"), "right").alias("completion_mask"))


@query("attention_mask", PAIR_ENC + f"""
select prompt, completion, list_transform(prompt_ids, lambda x: 1) as attention_mask, cast(len(prompt_ids) as integer) as n_real from enc
""")
def q_attention_mask(spark, sf_dir):
    d = taf_pair_ids(spark, sf_dir)
    return d.select("prompt", "completion", K.mask_for(F.col("prompt_ids"), F.size("prompt_ids")).alias("attention_mask"),
                    F.size("prompt_ids").alias("n_real"))
