"""TAF text rules as Spark column expressions.

Java and Python regexes differ in ``.`` (Java also stops at ``\\r`` and other terminators),
so patterns with ``.`` run under ``(?d)`` (UNIX_LINES), which makes ``\\n`` the only line
terminator as in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from taffeta.functions.text import JS_WS, col_of, py_split_ws, py_strip

# ---------------------------------------------------------------------------------------
# Patterns, tokens and templates that must equal the reference's behaviour.
RECORD_SPLIT = r"\n+#+\n+"
METADATA_TEMPS = r"(?:(TXM?\d{2}).+(TNM?\d{2}))"
TEMPERATURE_NAMED = r"(?:(?:TX)(?P<TX>M?\d{2}).+(?:TN)(?P<TN>M?\d{2}))"
STATION_AS_IS = r"^.*\s([A-Z]{4})\s"
STATION_FIRST = r"^TAF .*?\b([A-Z]{4}) \d{6}Z"
TEMPERATURE_GROUP = r"\sTX(M)?\d{2}\/\d{4}Z\sTN(M)?\d{2}\/\d{4}Z"
TEMPERATURE_END = (r"\sTX?(?P<maximum_temperature>M?\d{2})\/\d{4}Z"
                   r"\sTN?(?P<minimum_temperature>M?\d{2})\/\d{4}Z$")
CONFIG_METADATA_PATTERN = r"(?:(TXM?/\d{2}).+(TNM?/\d{2}))$"
CHANGE_GROUP_SPLIT = r"(?=BECMG|TEMPO)"
WIND_SPLIT = (r"(?<=\s(\d{3}|VRB))(?=\d{2,3}(KT|G\d{2,3}KT))"
              r"|(?=G\d{2,3}KT\s)"
              r"|(?<=G)(?=\d{2,3}KT\s)"
              r"|(?=KT\s)")
CLOUD_SPLIT = (r"(?<=FEW|SCT|BKN|OVC)(?=\d{3})"
               r"|(?<=(FEW|SCT|BKN|OVC)\d{3})(?=CB)")
LEGACY_TOKEN_SPLIT = (r"(?<=\s\d{3})(?=\d{2,3})|(?=KT)|(?=G\d{2}KT)|(?=G\d{3}KT)"
                      r"|(?<=FEW|SCT|BKN|OVC)|(?<=(FEW|SCT|BKN|OVC)\d{3})(?=CB)")
TEMPLATE = "TAF [{header}] {text}"
TEMPLATE_HEAD = "TAF "
BOS, EOS, PAD = "<|bos|>", "<|eos|>", "<|pad|>"
CORRECTION = r"\bCOR\b"
# ---------------------------------------------------------------------------------------

TOKEN_SPLITS = {"wind": WIND_SPLIT, "cloud": CLOUD_SPLIT,
                "all": WIND_SPLIT + "|" + CLOUD_SPLIT, "legacy": LEGACY_TOKEN_SPLIT}


def java_pattern(pattern: str) -> str:
    """Python regex -> Java regex, UNIX_LINES on. Named groups become plain groups (Java names
    allow no underscore; we extract by index and keep the names on the Python side)."""
    return "(?d)" + re.sub(r"\(\?P?<([A-Za-z_]\w*)>", "(", pattern)


def group_names(pattern: str) -> list[str | None]:
    """Capturing groups of a pattern in order: their name, or None when unnamed."""
    names: list[str | None] = []
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if m:
                names.append(m.group(1))
            elif not pattern.startswith("(?", i):
                names.append(None)
        i += 1
    return names


def extract(c, pattern: str, group: int) -> Column:
    """First match's group, null when the pattern does not match (pandas ``str.extract``)."""
    return F.nullif(F.regexp_extract(col_of(c), java_pattern(pattern), group), F.lit(""))


def extract_named(c, pattern: str) -> dict[str, Column]:
    """One column per named group (unnamed groups keep their 0-based position as name)."""
    out = {}
    for idx, name in enumerate(group_names(pattern), start=1):
        out[name if name else str(idx - 1)] = extract(c, pattern, idx)
    return out


def split_tokens(c, kind: str = "all") -> Column:
    """Cut TAF groups at the boundaries of a split pattern and rejoin with a space."""
    return F.regexp_replace(col_of(c), TOKEN_SPLITS[kind], " ")


def change_groups(c) -> Column:
    """Generated text -> lines: delete newlines, split before BECMG/TEMPO, drop empties, strip."""
    flat = F.replace(col_of(c), F.lit("\n"), F.lit(""))
    pieces = F.filter(F.split(flat, CHANGE_GROUP_SPLIT), lambda x: x != "")
    return F.transform(pieces, lambda x: py_strip(x))


def normalise_editor_text(c, upper: bool = True) -> Column:
    """Editor rule per line: drop leading whitespace, else a run of >=2 trailing whitespace;
    drop empty lines; rejoin with newlines; optionally upper-case first."""
    c = col_of(c)
    if upper:
        c = F.upper(c)
    lead = f"^{JS_WS}+"
    trail = f"{JS_WS}{JS_WS}+$"

    def fix(x):
        return F.when(x.rlike("(?d)" + lead), F.regexp_replace(x, "(?d)" + lead, "")) \
                .otherwise(F.regexp_replace(x, "(?d)" + trail, ""))

    lines = F.filter(F.transform(F.split(c, "\n"), fix), lambda x: x != "")
    return F.array_join(lines, "\n")


def all_upper(lines) -> Column:
    """Python ``all(line.isupper() for line in lines)``."""
    return F.forall(col_of(lines), lambda x: (F.upper(x) == x) & (F.lower(x) != x))


def next_word(c) -> Column:
    """First word of a completion: up to the first space after an optional leading space;
    ``''`` when no such space exists (JavaScript ``substring(0, -1)``)."""
    c = col_of(c)
    pos = F.when(c.startswith(" "), F.locate(" ", c, 2)).otherwise(F.locate(" ", c, 1))
    return F.when(pos == 0, F.lit("")).otherwise(F.substring(c, F.lit(1), pos - 1))


def next_line(c) -> Column:
    """First line of a completion plus a newline."""
    return F.concat(F.substring_index(col_of(c), "\n", 1), F.lit("\n"))


def last_line(c) -> Column:
    return F.substring_index(col_of(c), "\n", -1)


def suffix_after(full, prefix) -> Column:
    """``full[len(prefix):]``."""
    return F.substring(col_of(full), F.length(col_of(prefix)) + 1, F.lit(1 << 30))


def words(c) -> Column:
    return py_split_ws(c)
