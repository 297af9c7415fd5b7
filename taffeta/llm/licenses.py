"""License scans by ordered signature rules.

The rules are regular expressions, each with a label, a priority and a keyword. A rule runs only on
texts that hold its keyword. Both see each run of white space as one space, so that a notice may be
wrapped or spaced anyhow. Overlapping detections are resolved in order of priority, then length:
a detection inside the interval of one already kept goes. Offsets are code points of the text,
``end`` exclusive; letters A-Z match in either case.

Defined cases: a null text counts as empty; a text without words or rules' matches has empty lists.
No shuffle; each text is read once, whole, and rows are kept as they come.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taffeta.llm.hashing import ALNUM, Words, blocks

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases, and the labels that they give.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str


# Names as licences write them, and the versions that they have.
_VERSIONED = [
    ("apache", "apache", r"apache(?: software)?", "1.0 1.1 2.0"),
    ("gpl", "general public", r"(?<!lesser )(?<!library )(?<!affero )general public", "1.0 2.0 3.0"),
    ("lgpl", "general public", r"(?:lesser|library) general public", "2.0 2.1 3.0"),
    ("agpl", "affero", r"affero general public", "1.0 3.0"),
    ("gfdl", "free documentation", r"free documentation", "1.1 1.2 1.3"),
    ("mpl", "mozilla", r"mozilla public", "1.0 1.1 2.0"),
    ("epl", "eclipse", r"eclipse public", "1.0 2.0"),
    ("cddl", "common development", r"common development and distribution", "1.0 1.1"),
    ("cpl", "common public", r"common public", "0.5 1.0"),
    ("eupl", "european union", r"european union public", "1.0 1.1 1.2"),
    ("osl", "open software", r"open software", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic free", r"academic free", "1.1 1.2 2.0 2.1 3.0"),
    ("ofl", "open font", r"(?:sil )?open font", "1.0 1.1"),
    ("artistic", "artistic", r"artistic", "1.0 2.0"),
    ("bsl", "boost", r"boost software", "1.0"),
    ("ecl", "educational community", r"educational community", "1.0 2.0"),
    ("zpl", "zope", r"zope public", "1.1 2.0 2.1"),
    ("php", "php", r"php", "3.0 3.01"),
    ("python", "python", r"python software foundation", "2.0"),
    ("lppl", "latex project", r"latex project public", "1.0 1.1 1.2 1.3"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", "1.0"),
    ("odbl", "open database", r"open database", "1.0"),
    ("cecill", "cecill", r"cecill(?: free software)?", "1.0 1.1 2.0 2.1"),
    ("upl", "universal permissive", r"universal permissive", "1.0"),
    ("mulan", "mulan", r"mulan permissive software", "1.0 2.0"),
]
_PLAIN = [
    ("mit", "mit", r"\bmit[- ]licen[sc]ed?\b"), ("mit", "mit", r"\bmit licen[sc]e\b"),
    ("mit", "expat", r"\bexpat licen[sc]e\b"), ("isc", "isc", r"\bisc licen[sc]e\b"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? licen[sc]e\b"), ("unlicense", "unlicense", r"\bthe unlicense\b"),
    ("wtfpl", "what the f", r"\bdo what the f\S{0,4} you want to public licen[sc]e\b"),
    ("cc0", "cc0", r"\bcc0(?: 1\.0)?(?: universal)?\b"), ("public-domain", "public domain", r"\b(?:in|into|to) the public domain\b"),
    ("beerware", "beer", r"\bbeer-?ware licen[sc]e\b"), ("bsd", "bsd", r"\bbsd[- ]style licen[sc]e\b"),
    ("proprietary", "confidential", r"\bproprietary and confidential\b"), ("proprietary", "without permission", r"\bmay not be (?:copied|reproduced|distributed) without permission\b"),
    ("permissive-grant", "hereby granted", r"\bpermission is hereby granted, free of charge\b"),
    ("warranty-disclaimer", "as is", r"\bprovided [\"'“]?as is[\"'”]?,? without warranty\b"),
    ("copyright", "copyright", r"\bcopyright (?:\(c\) |© )?\d{4}(?:\s?[-–,]\s?\d{4})*\b"), ("copyright", "©", r"© ?\d{4}(?:\s?[-–,]\s?\d{4})*\b"),
    ("reserved", "rights reserved", r"\b(?:all|some|no) rights reserved\b"),
]
_CC = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nc": "attribution-noncommercial",
       "by-nd": "attribution-noderiv(?:ative)?s", "by-nc-sa": "attribution-noncommercial-sharealike",
       "by-nc-nd": "attribution-noncommercial-noderiv(?:ative)?s"}
_CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"


def _loose(words: str) -> str:
    return words.replace("-", r"[\s-]+").replace(" ", r"\s+")


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, the most specific ones first: named identifiers, versions, bare names, notices."""
    out = []
    for label, key, name, versions in _VERSIONED:
        spaced = name.replace("(?<!lesser )", "\1").replace("(?<!library )", "\2").replace("(?<!affero )", "\3")
        name = _loose(spaced).replace("\1", r"(?<!lesser\s)").replace("\2", r"(?<!library\s)").replace("\3", r"(?<!affero\s)")
        for v in versions.split():
            short = re.escape(v.removesuffix(".0"))
            number = rf"{short}(?:\.0)?(?![\d.]*\d)" if v.endswith(".0") else rf"{re.escape(v)}(?!\d)"
            out += [
                Rule(f"{label}-{v}", 80, key, rf"{name}\s+licen[sc]e\s*,?\s*\(?(?:version\s+|v\.?\s*)?{number}"),
                Rule(f"{label}-{v}-or-later", 90, key, rf"{name}\s+licen[sc]e[^.]{{0,80}}?(?:version\s+|v\.?\s*){number},?\s+or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later"),
                Rule(f"{label}-{v}", 100, "spdx", rf"spdx-license-identifier:\s*{label}-{number}(?:-only)?"),
                Rule(f"{label}-{v}-or-later", 110, "spdx", rf"spdx-license-identifier:\s*{label}-{number}-or-later"),
            ]
        out.append(Rule(label, 50, key, rf"{name}\s+licen[sc]e\b"))
    for n in "01234":
        out += [Rule(f"bsd-{n}-clause", 80, "bsd", rf"\bbsd[\s-]+{n}[\s-]+clause\b"),
                Rule(f"bsd-{n}-clause", 80, "clause", rf"\b{n}[\s-]+clause\s+bsd\b"),
                Rule(f"bsd-{n}-clause", 100, "spdx", rf"spdx-license-identifier:\s*bsd-{n}-clause\b")]
    for label, key, pattern in _PLAIN:
        out.append(Rule(label, 40, key, pattern))
    for kind, full in _CC.items():
        code = kind.replace("-", r"[\s-]+")
        out += [Rule(f"cc-{kind}", 60, "cc", rf"\bcc[\s-]+{code}\b(?![\s-]+(?:nc|nd|sa)\b)"),
                Rule(f"cc-{kind}", 50, "creative commons", rf"\bcreative\s+commons\s+{_loose(full)}\b")]
        for v in _CC_VERSIONS.split():
            number = re.escape(v)
            out += [Rule(f"cc-{kind}-{v}", 80, "cc", rf"\bcc[\s-]+{code}[\s-]+{number}\b"),
                    Rule(f"cc-{kind}-{v}", 70, "creative commons", rf"\bcreative\s+commons\s+{_loose(full)}\s+{number}\b"),
                    Rule(f"cc-{kind}-{v}", 100, "creativecommons", rf"creativecommons\.org/licenses/{kind}/{number}"),
                    Rule(f"cc-{kind}-{v}", 100, "spdx", rf"spdx-license-identifier:\s*cc-{kind}-{number}\b")]
    return tuple(sorted(set(out), key=lambda r: (-r.priority, r.label, r.pattern)))


@cache
def _by_keyword() -> dict[str, list[tuple[Rule, re.Pattern]]]:
    out: dict[str, list] = {}
    for r in rules():
        out.setdefault(r.keyword, []).append((r, re.compile(r.pattern)))
    return out


@cache
def _phrases() -> list[tuple[list[str], str, re.Pattern]]:
    return [(p.split(), label, re.compile(_GAP.join(p.split()) + f"(?!{_WORD})")) for p, label in PHRASES.items()]


_WORDS, _WORD_CHAR = re.compile(_WORD + "+"), re.compile(_WORD)


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


_SPACE, _UNFOLDED = re.compile(r"\s+"), re.compile(r"[^\S ]|\s\s")


def _unfold(low: str, found: list) -> list:
    """The same detections with their offsets in the text before its white space was folded."""
    begins, shifts, shift = [0], [0], 0
    for m in _SPACE.finditer(low):
        if m.end() - m.start() > 1:
            begins.append(m.start() - shift + 1)
            shift += m.end() - m.start() - 1
            shifts.append(shift)

    def back(i):
        return i + shifts[bisect.bisect_right(begins, i) - 1]

    return [(label, back(start), back(end - 1) + 1, priority) for label, start, end, priority in found]


def detect(low: str) -> list[tuple[str, int, int, int]]:
    """(label, start, end, priority) of what is kept, by start."""
    found = []
    folded = _SPACE.sub(" ", low) if _UNFOLDED.search(low) else low
    for keyword, group in _by_keyword().items():
        if keyword in folded:
            for rule, pattern in group:
                found += [(rule.label, m.start(), m.end(), rule.priority) for m in pattern.finditer(folded)]
    if len(folded) < len(low):
        found = _unfold(low, found)
    found.sort(key=lambda d: (-d[3], d[1] - d[2], d[1], d[0]))
    kept: list[tuple[str, int, int, int]] = []
    reach: list[tuple[int, int]] = []  # kept intervals by start, none inside another
    for d in found:
        i = bisect.bisect_right(reach, (d[1], 1 << 60))
        if i and reach[i - 1][1] >= d[2]:
            continue
        j = i
        while j < len(reach) and reach[j][1] <= d[2]:
            j += 1
        if i and reach[i - 1][0] == d[1]:
            i -= 1
        reach[i:j] = [(d[1], d[2])]
        kept.append(d)
    return sorted(kept, key=lambda d: (d[1], d[2], d[0]))


def places(low: str) -> list[tuple[str, int]]:
    """(label, index of the first word) of each place where a phrase's words stand consecutively."""
    hits = []
    for words, label, pattern in _phrases():
        if all(w in low for w in words):
            hits += [(m.start(), label) for m in pattern.finditer(low) if not (m.start() and _WORD_CHAR.match(low, m.start() - 1))]
    if not hits:
        return []
    starts = np.array([m.start() for m in _WORDS.finditer(low)])
    return [(label, int(np.searchsorted(starts, at))) for at, label in sorted(hits)]


_PLACES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))
_FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                                   T.StructField("end", T.LongType()), T.StructField("priority", T.IntegerType())]))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``places`` (of the phrases) and ``detections`` (of the rules)."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("places", _PLACES), T.StructField("detections", _FOUND)]
    df = df.drop(*[f.name for f in added])
    schema, at = T.StructType([*df.schema.fields, *added]), df.columns.index(text)
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    found = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in blocks(texts):
                low = [ascii_lower(t) if t else "" for t in texts[a:b]]
                words = np.diff(Words(low, ALNUM).first)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(words, pa.int64()),
                     pa.array([[{"label": x, "word": w} for x, w in places(t)] for t in low], place),
                     pa.array([[dict(zip(("label", "start", "end", "priority"), d)) for d in detect(t)] for t in low], found)],
                    names=[*batch.schema.names, "n_words", "places", "detections"])

    return df.mapInArrow(run, schema)


def summary(df: DataFrame) -> DataFrame:
    """One row of labels and counts for each scanned document. Score: the highest priority of a
    kept detection against the highest there is, half of it if only a phrase was found, else 0."""
    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    top = F.array_max(F.transform("detections", lambda d: d["priority"])) / F.lit(float(rules()[0].priority))
    base = F.transform("places", lambda p: p["label"])
    return df.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.coalesce(top, F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"))
