"""Language ID by Bayesian fusion of evidence.

The posterior of a language is the product of

* the text's likelihood: naive Bayes over hashed byte trigrams of lower-case letters, counted on all labelled rows.
  Trigrams of a text depend on each other, so its log-likelihood is tempered;
* the likelihood of the declared language (markup or a table's column), from how often texts of each language declare
  which one; a declaration of an unknown language is one more value, none at all is no evidence;
* a prior of the host, smoothed over host, registered domain, address suffix and all rows: at each level the counts of
  the languages that the texts alone show, without the row itself, are added to ``strength`` times the level above.

One class more stands for no language at all: its text model is uniform over trigrams.  A row is rejected where that class
wins, where it has too few trigrams, or where the best language's posterior is below ``least``.

Counts are grouped aggregations over all rows, combined before they are shuffled; per row only its scores are joined
with its host's counts.  The host side has one row per host, and its rows are small, so a host with a third of the
rows splits (adaptive skew join).
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from virocohort.session import cut_lineage

BUCKETS = 1 << 15
MARKUP = re.compile(rb"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = re.compile(rb"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)")
SCORED = "score array<double>, grams long, shown int"


def page_text(page: bytes | None) -> tuple[bytes, str | None]:
    """The visible text of a page, and the primary tag of the language that its html element declares."""
    page = page or b""
    m = DECLARED.search(page)
    text = html.unescape(MARKUP.sub(b" ", page).decode("utf-8", "replace")).encode()
    return text, m[1].decode().lower() if m else None


def pages_as_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as id, text, declared, host.  A url without ``://`` has no host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [page_text(h.as_py()) for h in batch.column("html").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t for t, _ in both], pa.binary()).cast(pa.string()), pa.array([d for _, d in both], pa.string()), batch.column("host")],
                                             names=["id", "text", "declared", "host"])

    url = F.col(url_col).cast("string")
    host = F.when(F.instr(url, "://") > 0, F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    return rows.mapInArrow(run, "id long, text string, declared string, host string")


def documents_as_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Documents as id, text, declared, host: the source takes the host's place."""
    c = lambda name: F.col(name).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), c(text_col).alias("text"), F.lower(c(lang_col)).alias("declared"), c(host_col).alias("host"))


LETTERS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))


def grams(texts: Sequence[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some megabytes at a time: the first text's number, trigram buckets, and each one's text (from that number on).

    Letters alone count, in lower case; what is between them is one blank.
    """
    i = 0
    while i < len(texts):
        start, parts, size = i, [], 0
        while i < len(texts) and size < 2 << 20:
            t = texts[i] or b""
            t = t.lower() if t.isascii() else t.decode("utf-8", "replace").lower().encode()
            parts.append(b" " + b" ".join(t.translate(LETTERS).split()) + b" ")
            size, i = size + len(parts[-1]), i + 1
        x = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        if len(x) < 3:
            continue
        inside = owner[2:] == owner[:-2]
        code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(17)
        yield start, code[inside], owner[:-2][inside]


def text_model(labelled: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Log probabilities of buckets by language, from all rows (text, declared) with one of the languages."""
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(number), BUCKETS), np.int64)
        for batch in batches:
            label = np.array([number.get(x, -1) for x in batch.column("declared").to_pylist()])
            for start, code, owner in grams(batch.column("text").cast(pa.binary()).to_pylist()):
                which = label[start + owner]
                for k in range(len(number)):
                    sums[k] += np.bincount(code[which == k], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums.ravel()[np.flatnonzero(sums)])], names=["k", "n"])

    sums = np.zeros(len(number) * BUCKETS)
    rows = labelled.where(F.col("declared").isin(list(languages))).select("text", "declared").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # languages x buckets rows at most
    sums[found.column("k").to_numpy()] = found.column("n").to_numpy()
    sums = sums.reshape(len(number), BUCKETS) + 0.5
    return np.log(sums / sums.sum(axis=1, keepdims=True))


def text_scores(rows: DataFrame, model: np.ndarray, temper: float, fewest: int) -> DataFrame:
    """The rows without text, with tempered log-likelihoods of the languages and, last, of no language; trigrams; the
    language that the text alone shows (null with too few trigrams or where no language wins)."""
    table = np.vstack([model, np.full(BUCKETS, -math.log(BUCKETS))]).astype(np.float32)
    others = [c for c in rows.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = np.zeros((batch.num_rows, len(table))), np.zeros(batch.num_rows, np.int64)
            for start, code, owner in grams(batch.column("text").cast(pa.binary()).to_pylist()):
                count = np.bincount(owner)
                n[start:start + len(count)] += count
                for k in range(len(table)):
                    total[start:start + len(count), k] += np.bincount(owner, table[k][code])
            best = total.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(list(total * temper), pa.list_(pa.float64())), pa.array(n),
                                              pa.array(best, pa.int32(), mask=(n < fewest) | (best == len(table) - 1))], names=[*others, "score", "grams", "shown"])

    return rows.mapInArrow(score, StructType([*(f for f in rows.schema if f.name != "text"), *StructType.fromDDL(SCORED)]))


def host_counts(rows: DataFrame, n: int) -> DataFrame:
    """Per host: how often each language shows, on the host, in its domain and under its suffix (arrays of n)."""
    counts = F.array(*[F.sum(F.when(F.col("shown") == k, 1).otherwise(0)) for k in range(n)])
    add = lambda c: F.array(*[F.sum(F.col(c)[k]) for k in range(n)])
    labels = F.split("host", r"\.")
    hosts = (rows.where("host is not null").groupBy("host").agg(counts.alias("of_host")).withColumn("labels", labels)
             .withColumn("domain", F.when(F.size("labels") > 2, F.array_join(F.slice("labels", -2, 2), ".")).otherwise(F.col("host")))
             .withColumn("suffix", F.when(F.size("labels") > 1, F.element_at("labels", -1)).otherwise(F.lit(""))).drop("labels"))
    domains = hosts.groupBy("suffix", "domain").agg(add("of_host").alias("of_domain"))
    suffixes = domains.groupBy("suffix").agg(add("of_domain").alias("of_suffix"))
    return hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix")


def identify(rows: DataFrame, model: np.ndarray, languages: Sequence[str], temper: float = 0.2, strength: float = 4.0,
             unknown: float = 1e-3, least: float = 0.5, fewest: int = 3) -> DataFrame:
    """Rows have id, text, declared, host (and may have more columns, but none of score, grams, shown, own, said, weight, top, best).  The result has all but text, and language (``und`` where rejected),
    posterior, accepted, text_language.

    Null or empty texts, and those without letters, are rejected; a null host has the prior of all rows, a null declaration
    is no evidence.  Repeated rows are judged each.  An empty table gives an empty result.
    """
    n = len(languages)
    scored = cut_lineage(text_scores(rows, model, temper, fewest))
    shown = scored.where("shown is not null")
    declared = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("declared")).cast("int"), F.lit(0))
    table = np.ones((n, n + 1))  # declared: 0 stands for others
    whole = np.ones(n)
    for r in shown.groupBy("shown", F.when(F.col("declared").isNotNull(), declared).alias("d")).count().collect():  # n * (n + 2) rows at most
        whole[r[0]] += r[2]
        if r[1] is not None:
            table[r[0], r[1]] += r[2]
    table, whole = table / table.sum(axis=1, keepdims=True), whole / whole.sum()
    numbers = lambda x: F.array(*[F.lit(float(v)) for v in x])
    # the row itself is taken out of its levels' counts
    own = F.array(*[F.when(F.col("shown") == k, 1.0).otherwise(0.0) for k in range(n)])

    def smooth(counts: str, above):
        rest = F.zip_with(F.coalesce(F.col(counts).cast("array<double>"), numbers([0] * n)), "own", lambda c, o: F.greatest(c - o, F.lit(0.0)))
        total = F.aggregate(rest, F.lit(0.0), lambda a, c: a + c)
        return F.zip_with(rest, above, lambda c, p: (c + strength * p) / (total + strength))

    said = F.coalesce(*[F.when(F.col("declared").isNotNull() & (declared == d), numbers(np.log(table[:, d]))) for d in range(n + 1)], numbers([0] * n))
    joined = scored.join(host_counts(shown, n).drop("domain", "suffix"), "host", "left").withColumn("own", own)
    for level, above in (("of_suffix", numbers(whole)), ("of_domain", F.col("of_suffix")), ("of_host", F.col("of_domain"))):
        joined = joined.withColumn(level, smooth(level, above))
    joined = joined.withColumn("said", said).withColumn("weight", F.concat(
        F.zip_with(F.zip_with(F.slice("score", 1, n), F.col("of_host"), lambda s, p: s + F.log(p)), F.col("said"), lambda s, d: s + d + math.log(1 - unknown)),
        F.array(F.element_at("score", -1) + math.log(unknown))))
    top = F.array_max("weight")
    joined = joined.withColumn("top", top).withColumn("best", F.array_position("weight", F.col("top")).cast("int")).withColumn(
        "posterior", 1 / F.aggregate("weight", F.lit(0.0), lambda a, w: a + F.exp(w - F.col("top"))))
    joined = joined.withColumn("accepted", (F.col("best") <= n) & (F.col("grams") >= fewest) & (F.col("posterior") >= least))
    names = F.array(*[F.lit(x) for x in languages])
    keep = [c for c in scored.columns if c not in ("score", "grams", "shown")]
    return joined.select(
        *keep, F.when(F.col("accepted"), F.element_at(names, F.least("best", F.lit(n)))).otherwise(F.lit("und")).alias("language"), F.round("posterior", 6).alias("posterior"),
        "accepted", F.when(F.col("shown").isNotNull(), F.element_at(names, F.coalesce(F.col("shown"), F.lit(0)) + 1)).alias("text_language"))
