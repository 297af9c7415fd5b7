"""Result scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taffeta.functions import taf


def generated_lines(df: DataFrame, prompt: str = "prompt", completion: str = "completion",
                    out: str = "generated_text") -> DataFrame:
    """The pipeline's output lines for a result row: decode text (prompt + completion), delete
    newlines, split before BECMG/TEMPO, strip."""
    return df.withColumn(out, taf.change_groups(F.concat(F.col(prompt), F.col(completion))))


def score(df: DataFrame, prompt: str = "prompt_text", lines: str = "generated_text",
          variant: str = "validate", penalty: float = -5.0) -> DataFrame:
    """E1 (``validate``) / E2 (``penalty``).

    Only a prompt whose last line contains ``TS`` is scored. E1: the single generated line that
    starts with that last line must hold ``CB`` (+1, else -1) and every line must be upper case
    (+1, else -1). E2 takes the first such line and charges ``penalty`` for lower case.
    Where the reference would raise (no line, or several for E1) the score is null and
    ``score_error`` says why.
    """
    last = taf.last_line(F.col(prompt))
    matches = F.filter(F.col(lines), lambda x: x.startswith(last))
    n = F.size(matches)
    cb = F.when(F.element_at(matches, 1).contains("CB"), F.lit(1.0)).otherwise(F.lit(-1.0))
    upper_ok = taf.all_upper(F.col(lines))
    scored = last.contains("TS")
    if variant == "validate":
        s = cb + F.when(upper_ok, F.lit(1.0)).otherwise(F.lit(-1.0))
        ok = n == 1
        err = F.when(scored & (n == 0), F.lit("no_line")).when(scored & (n > 1), F.lit("many_lines"))
    elif variant == "penalty":
        s = cb + F.when(upper_ok, F.lit(1.0)).otherwise(F.lit(float(penalty)))
        ok = n >= 1
        err = F.when(scored & (n == 0), F.lit("no_line"))
    else:
        raise ValueError(variant)
    value = F.when(~scored, F.lit(0.0)).when(ok, s)
    return df.withColumns({"score": value, "score_error": err})


def score_report(df: DataFrame, tie_keys=("strategy", "rec_id")) -> DataFrame:
    """Scored results, lowest score first."""
    return df.orderBy(F.col("score").asc_nulls_first(), *tie_keys)
