"""Whitespace-exact string helpers.

Python's ``str.strip``/``str.split`` and JavaScript's ``\\s`` use Unicode whitespace, Spark's
``trim`` removes spaces only and Java's ``\\s`` is ASCII unless ``(?U)``. We therefore spell the
whitespace set out as an explicit character class with ``\\x{..}`` escapes, which Java and RE2
(DuckDB) read the same way, so Spark and the SQL oracle split identically.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_class(chars) -> str:
    """Regex character class of the given characters, as ``\\x{hex}`` escapes."""
    return "[" + "".join("\\x{%x}" % ord(c) for c in sorted(set(chars))) + "]"


# Python's whitespace: derived by rule from str.isspace over all code points.
PY_WHITESPACE = tuple(chr(c) for c in range(0x110000) if chr(c).isspace())
PY_WS = char_class(PY_WHITESPACE)

# JavaScript's \s (ECMAScript WhiteSpace + LineTerminator), used by the editor rules.
JS_WHITESPACE = (
    "\t", "\n", "\x0b", "\x0c", "\r", " ", "\u00a0", "\u1680",
    "\u2000", "\u2001", "\u2002", "\u2003", "\u2004", "\u2005", "\u2006", "\u2007",
    "\u2008", "\u2009", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff",
)
JS_WS = char_class(JS_WHITESPACE)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_PY_WS_CHARS = "".join(PY_WHITESPACE)


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace (``btrim`` with the
    whitespace set: no regex)."""
    return F.btrim(col_of(c), F.lit(_PY_WS_CHARS))


def py_split_ws(c) -> Column:
    """Python ``str.split()``: split on runs of whitespace, no empty tokens, ``''`` -> ``[]``.
    Runs are first collapsed to one space by a cached regex, then the split is on a literal
    space (Java's single-character fast path, no per-row pattern compile)."""
    s = py_strip(c)
    one = F.regexp_replace(s, f"{PY_WS}+", " ")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(one, " "))


def tokens_of(c, specials=()) -> Column:
    """Whitespace tokens with the given special tokens cut out as tokens of their own."""
    c = col_of(c)
    if specials:
        alt = "|".join(_quote(s) for s in specials)
        c = F.regexp_replace(c, f"({alt})", " $1 ")
    return py_split_ws(c)


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}" else ch for ch in s)


def regex_quote(s: str) -> str:
    """Escape a literal for use inside a pattern (the reference's ``re.escape`` helper)."""
    return _quote(s)
