"""Secret scans: token patterns, and password guess costs of values in a credential context.

Base spans are matches of three patterns. On top of them, each value that stands behind a
credential word (``pwd: ...``, ``auth_token=...``) is weighed by a guess-cost dynamic programme: the
cheapest segmentation into dictionary words, dates, repeats, sequences, keyboard walks and
brute-force spans, as the logarithm of the guesses that an attacker needs. A value that costs at
least 10**STRONG guesses gives a span of kind ``guess`` (the value alone).

Offsets are code points, ``end`` exclusive. Defined cases: a null text counts as empty and has no
spans. No shuffle; whole texts; rows are kept as they come.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret.
STRONG = 8.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter run can't hold a longer one
_HEX = re.compile(r"[0-9a-f]{16,}")
#: A whole run of letters in front of a separator; whether it is a credential word is asked afterwards, so
#: that no run and no value is read more than once.
_NAME = re.compile(r"""(?<![A-Za-z_])([A-Za-z_]++)["']?\s?[:=]\s?["']?""", re.A)
_CREDENTIAL = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|api_?key|credential|auth", re.I | re.A)
_VALUE = re.compile(r"""[^\s"'<>,;]{6,}""", re.A)
_HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "auth")

#: Frequent password parts, the most frequent first.
COMMON = ("password 123456 qwerty admin welcome letmein login abc123 monkey dragon iloveyou master sunshine "
          "princess football baseball shadow superman trustno1 hello freedom whatever secret changeme default "
          "guest root user test demo pass love god summer winter spring autumn hunter jordan michael jennifer "
          "charlie thomas daniel george computer internet server database system manager service access "
          "token key private public example sample company office money power magic star blue green black "
          "white orange silver gold tiger eagle wolf lion bear cat dog fish bird home house world live "
          "the and for you not with this that from have word dead beef cafe babe face feed").split()
_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
_LONGEST = max(map(len, COMMON))
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEAR = {(a, b) for row in _ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]} | {
    (a, b) for upper, lower in zip(_ROWS, _ROWS[1:]) for k, x in enumerate(lower)
    for y in upper[k + (upper is _ROWS[0]) : k + 2 + (upper is _ROWS[0])] for a, b in ((x, y), (y, x))}
_UNLEET = str.maketrans("@4301$57!", "aaeoissti")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
#: Spans of one model are at most so long; longer runs are several spans.
SPAN = 32


def _alphabet(value: str) -> int:
    groups = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    size = sum(n for test, n in groups if any(test(c) and c < "\x80" for c in value))
    size += 33 * any(c < "\x80" and not c.isalnum() for c in value) + 100 * any(c >= "\x80" for c in value)
    return max(size, 2)


@lru_cache(maxsize=50_000)
def guess_cost(value: str) -> float:
    """log10 of the guesses for the cheapest segmentation of ``value``; linear in its length."""
    n, brute = len(value), math.log10(_alphabet(value))
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_UNLEET)
    best = [0.0] + [math.inf] * n
    walk, run, turn = 1, 1, 0  # lengths of the keyboard walk, of the repeat and of the sequence that end here
    seq, delta = 1, 0
    dates: dict[int, list[int]] = {}
    for m in _DATE.finditer(value):
        dates.setdefault(m.end(), []).append(m.start())
    for j in range(1, n + 1):
        if j > 1:
            near = (low[j - 2], low[j - 1]) in _NEAR
            walk = min(walk + 1, SPAN) if near else 1
            run = min(run + 1, SPAN) if value[j - 1] == value[j - 2] else 1
            step = ord(value[j - 1]) - ord(value[j - 2])
            seq = min(seq + 1, SPAN) if step in (1, -1) and step == delta else (2 if step in (1, -1) else 1)
            delta = step
        cost = best[j - 1] + brute
        for size in range(3, min(_LONGEST, j) + 1):
            word, raw = plain[j - size : j], low[j - size : j]
            rank = _RANK.get(raw) or _RANK.get(word)
            if rank:
                odd = (raw not in _RANK) + (value[j - size : j] != raw)
                cost = min(cost, best[j - size] + math.log10(rank + 1) + 0.5 * odd)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + (2.1 if j - i == 4 else 4.6))
        for size, price in ((walk, 2.0), (run, brute), (seq, 1.5)):
            if size >= 3:
                cost = min(cost, best[j - size] + price + math.log10(size))
        # a unit of 2 to 8 characters again and again costs the unit and the number of times
        for unit in range(2, 9):
            if j >= 2 * unit and value[j - unit : j] == value[j - 2 * unit : j - unit]:
                cost = min(cost, best[j - unit] + 0.5)
        best[j] = cost
    return best[n]


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values stand that follow a credential word; names within a value are part of it."""
    at = 0
    while name := _NAME.search(text, at):
        at = name.end()
        dashed = name[1][:3].lower() == "key" and text[max(0, name.start() - 4) : name.start()].lower() == "api-"
        if dashed or _CREDENTIAL.search(name[1]):
            if value := _VALUE.match(text, at):
                yield value.span()
                at = value.end()


def spans(text: str | None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, guess cost or null), by start, then kind."""
    if not text:
        return []
    found = [("access", *m.span(), None) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [("hex", *m.span(), None) for m in _HEX.finditer(text)]
    low = text.lower()
    if ("=" in text or ":" in text) and any(h in low for h in _HINTS):
        found += [("assign", *m.span(), guess_cost(m[2])) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        found += [("guess", i, j, cost) for i, j in _values(text) if (cost := guess_cost(text[i:j])) >= STRONG]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                   T.StructField("end", T.LongType()), T.StructField("log10_guesses", T.DoubleType())]))


def scan(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds the array of spans; a column of that name is replaced."""
    df = df.drop(out)
    schema, at = T.StructType([*df.schema.fields, T.StructField(out, _SPANS)]), df.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "log10_guesses"), s)) for s in spans(t)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def summary(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts of the base kinds, the hash of their list, and the list of all spans."""
    def listed(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter(spans, lambda s: s["kind"] != "guess")
    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return df.select("doc_id", *counts[:3], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans"), counts[3])
