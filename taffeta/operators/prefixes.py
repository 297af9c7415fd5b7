"""Prompt/completion expansion.

Every record of n whitespace tokens yields n-1 pairs: prompt = BOS + the first i tokens, each
followed by a space; completion = the remaining tokens joined by a space + EOS.

De-duplication happens on the record *before* expansion. Two pairs are equal only if their
prompt and completion are equal, i.e. if the token lists of their records are equal and the cut
is the same; so de-duplicating whitespace-normalised records and then expanding yields exactly
the distinct pairs, while the shuffle carries each record once instead of O(n^2) pair bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taffeta.functions.generators import explode_rows

from taffeta.functions.taf import BOS, EOS
from taffeta.functions.text import py_strip, py_split_ws


def _cuts(n):
    # 1..n-1, guarded: sequence(1, 0) would count down and invent two rows for one token.
    return F.when(n > 1, F.sequence(F.lit(1), n - 1))


def tokenise(df: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Python ``str.strip().split()``."""
    return df.withColumn(out, py_split_ws(text_col))


def prefix_pairs(df: DataFrame, text_col: str = "templated", bos: str = BOS, eos: str = EOS,
                 dedup: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """G1 (+A1 when ``dedup``): all (prompt, completion) prefix splits of each text.

    The text is first normalised to single-space-separated tokens; pair i then cuts that string
    after its i-th token (``substring_index`` from the left, and from the right for the rest), so each pair is
    two native copies found by bytes, with no per-pair array building. ``keep`` columns ride along to every pair
    of their text (with ``dedup`` they must be functions of the text, e.g. a split keyed on it).
    """
    w = df.select(*keep, F.array_join(py_split_ws(text_col), " ").alias("_norm"))
    if dedup:
        w = w.dropDuplicates(["_norm"])
    # no filter on the token count: it would depend on the group key only and be pushed below
    # the de-dup to the scan, re-running the whole text derivation; the guarded cut sequence
    # already yields nothing for a one-token text
    w = w.withColumn("_n", F.size(F.split(F.col("_norm"), " ")))
    x = explode_rows(w, [*keep, "_norm", "_n"], _cuts(F.col("_n")), "_i")
    return x.select(*keep,
                    F.concat(F.lit(bos), F.expr("substring_index(_norm, ' ', _i)"), F.lit(" ")).alias("prompt"),
                    F.concat(F.expr("substring_index(_norm, ' ', _i - _n)"), F.lit(eos)).alias("completion"))


def prefix_cuts(df: DataFrame, key_col: str, text_col: str = "text") -> DataFrame:
    """Compact G1: (key, cut, n_tokens) per pair; texts are rebuilt from the token array only
    where needed. Linear in the corpus, whereas materialised pairs are quadratic per record."""
    d = df.select(key_col, F.size(py_split_ws(text_col)).alias("n_tokens"))
    return explode_rows(d, [key_col, "n_tokens"], _cuts(F.col("n_tokens")), "cut")


def dedup_pairs(df: DataFrame, cols=("prompt", "completion")) -> DataFrame:
    """A1: exact de-dup over all columns (duplicates are identical, so keep-first is moot)."""
    return df.dropDuplicates(list(cols))


def request_prompts(df: DataFrame, text_col: str, out: str = "prompt") -> DataFrame:
    """What is sent to the generator: the text stripped; nothing is sent for a blank or missing one."""
    return df.withColumn(out, py_strip(text_col)).where(F.col(out) != "")
