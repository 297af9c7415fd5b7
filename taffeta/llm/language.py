"""Language identification by Bayesian evidence fusion.

The posterior of a page's language multiplies the likelihood of its text under byte-trigram models
(one for each language, counted over all labelled documents), the likelihoods of the declared markup
language and of the address suffix, and a prior of the host. The evidence tables are grouped counts of
the pages' own text-only decisions. The host's prior is smoothed hierarchically: host by registered
domain, domain by its suffix, suffix by the whole corpus.

Trigrams overlap and repeat, so the text counts as much as the square root of its trigrams' number.

Defined cases: null pages and texts count as empty; they go by the other evidence. A missing lang
attribute or address is a value of its own. Without labelled documents the language is null.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taffeta.llm.hashing import LOWER, blocks
from taffeta.session import materialise

BUCKETS = 1 << 14
#: Pseudo-counts that a level takes from the one above it.
STRENGTH = 4.0

_SKIP = re.compile(r"<(?:!--|(script|style)\b)", re.I)
_END = {kind: re.compile(end, re.I) for kind, end in (("", "-->"), ("script", r"</script\s*>"), ("style", r"</style\s*>"))}
_HTML = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_ADDRESS = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?(?:/([A-Za-z]{2})(?=[/?#]|$))?", re.I)


def page_text(page: str | None) -> str:
    """A page without comments, scripts, styles and then tags, each of which becomes a space. What has no
    end stays. Linear in the page: where one mark has no end, no later one of its kind is tried."""
    page, out, done, at, endless = page or "", [], 0, 0, set()
    while found := _SKIP.search(page, at):
        at, kind = found.end(), (found[1] or "").lower()
        end = None if kind in endless else _END[kind].search(page, at)
        if end:
            out += [page[done : found.start()], " "]
            done = at = end.end()
        else:
            endless.add(kind)
    page, out, done = "".join([*out, page[done:]]), [], 0
    while (start := page.find("<", done)) >= 0 and (end := page.find(">", start)) >= 0:
        out += [page[done:start], " "]
        done = end + 1
    return html.unescape("".join([*out, page[done:]]))


def declared(page: str | None) -> str:
    """The first lang attribute of an html tag."""
    for tag in _HTML.finditer(page or ""):
        if found := _LANG.search(tag[0]):
            return found[1].lower()
    return ""


def address(url: str | None) -> tuple[str, str, str]:
    """(host, registered domain, suffix); the suffix is the last label, with a two-letter first path
    part if there is one."""
    found = _ADDRESS.match(url or "")
    if not found:
        return "", "", ""
    host = found[1].lower().rstrip(".")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] + (f"/{found[2].lower()}" if found[2] else "")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text."""
    b = LOWER[np.frombuffer(f"  {text} ".encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def models(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of each bucket under each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if l not in total:
                    total[l] = np.zeros(BUCKETS, np.int64)
                total[l] += np.bincount(trigrams(t or ""), minlength=BUCKETS)
        for l, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang).isNotNull()).select(text, lang).mapInArrow(run, "lang string, bucket int, n long")
    found: dict[str, np.ndarray] = {}
    for l, bucket, n in rows.groupBy("lang", "bucket").agg(F.sum("n")).collect():
        found.setdefault(l, np.zeros(BUCKETS))[bucket] = n
    langs = sorted(found)
    return langs, np.log(np.array([(found[l] + 0.5) / (found[l].sum() + 0.5 * BUCKETS) for l in langs]).reshape(len(langs), BUCKETS))


def _evidence(pages: DataFrame, langs: list[str], log: np.ndarray) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(log)  # languages x BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            urls, raw = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in blocks(raw):
                likely = []
                for page in raw[a:b]:
                    grams = trigrams(page_text(page).strip())
                    likely.append(table[grams].mean(axis=0) * np.sqrt(max(0, len(grams) - 1)))
                hosts = [address(u) for u in urls[a:b]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), *[pa.array([h[i] for h in hosts], pa.string()) for i in range(3)],
                    pa.array([declared(p) for p in raw[a:b]], pa.string()), pa.array([x.tolist() for x in likely], pa.list_(pa.float64())),
                    pa.array([int(x.argmax()) for x in likely], pa.int32())], names=["page_id", "host", "domain", "suffix", "declared", "likely", "best"])

    schema = "page_id long, host string, domain string, suffix string, declared string, likely array<double>, best int"
    return materialise(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, schema), "language-evidence")


def identify(spark: SparkSession, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, posterior, text_lang and declared of each page."""
    langs, log = models(docs)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"))
    rows, n = _evidence(pages, langs, log), len(langs)
    votes = F.array(*[F.sum((F.col("best") == i).cast("double")) for i in range(n)])
    base = rows.agg(*[F.sum((F.col("best") == i).cast("double")) for i in range(n)]).first()
    total = sum(x or 0 for x in base)
    overall = F.array(*[F.lit(((x or 0) + 1) / (total + n)) for x in base])

    def smoothed(counts, above):
        size = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(counts, above, lambda c, p: (c + STRENGTH * p) / (size + STRENGTH))

    def given(key):
        """log P(value of the evidence | language), up to a constant for each value."""
        p = rows.groupBy(key).agg(votes.alias("c")).select(key, smoothed("c", overall).alias("p"))
        return p.select(key, F.zip_with("p", overall, lambda x, y: F.log(x) - F.log(y)).alias(f"log_{key}"))

    top = F.substring_index("suffix", "/", 1)
    counts = materialise(rows.groupBy("host", "domain", top.alias("top")).agg(votes.alias("c")), "language-hosts")

    def level(*keys):
        added = F.array(*[F.sum(F.col("c")[i]) for i in range(n)])
        return counts.groupBy(*keys).agg(added.alias("c"))

    tops = level("top").select("top", smoothed("c", overall).alias("p_top"))
    domains = level("domain", "top").join(tops, "top").select("domain", "top", smoothed("c", F.col("p_top")).alias("p_domain"))
    hosts = level("host", "domain", "top").join(domains, ["domain", "top"]).select("host", smoothed("c", F.col("p_domain")).alias("p_host"))
    prior = materialise(hosts.select("host", F.transform("p_host", lambda p: F.log(p)).alias("log_host")), "language-priors")
    marks, suffixes = (materialise(given(k), f"language-{k}") for k in ("declared", "suffix"))

    both = rows.join(prior, "host", "left").join(marks, "declared", "left").join(suffixes, "suffix", "left")
    added = F.col("likely")
    for c in ("log_host", "log_declared", "log_suffix"):
        added = F.zip_with(added, F.col(c), lambda x, y: x + y)
    both = both.withColumn("z", added).withColumn("top", F.array_max("z"))
    weights = F.transform("z", lambda x: F.exp(x - F.col("top")))
    names = F.array(*[F.lit(l) for l in langs])
    at = F.array_position("z", F.col("top")).cast("int")
    return both.select("page_id", F.element_at(names, at).alias("lang"),
                       (F.lit(1.0) / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)).alias("posterior"),
                       F.element_at(names, F.col("best") + 1).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"))
