"""Reusable DuckDB SQL fragments for the oracles (same fixed values as the Spark side)."""

from taffeta.functions.text import PY_WS

WS = PY_WS


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def split_ws(x: str) -> str:
    s = strip(x)
    return f"(case when {s} = '' then []::varchar[] else regexp_split_to_array({s}, '{WS}+') end)"


def extract(x: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"
