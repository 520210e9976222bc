"""Phrase collocation mining by a multikey quicksort of word suffixes.

Every word of a piece begins a suffix of at most ``depth`` words.  Suffixes are dealt to buckets by their leading words: by one
word where suffixes beginning with it fit a task, else by two, and so on.  How many words is read from a table of counters
of fixed size over all suffixes, so a leading word that a third of the corpus has is spread.  Equal suffixes
of a part of the table travel once, with their number.

A bucket sorts pointers to its suffixes three ways: smaller, equal and greater than a pivot word at the current place; the
equal part goes on with the next place.  The weight of an equal part is the count of the phrase that its pointers share.  Parts that
weigh less than ``least`` are abandoned, but for phrases so short that other buckets hold some of their suffixes: those
are summed afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from virocohort.session import cut_lineage

BREAKS = re.compile(r"[.,;:!?\n-\r]")
BLANKS = re.compile(r"[^ \t]+")
COUNTERS = 1 << 16
EMPTY = -1  # no word: the piece ends before this place
#: decimals of 38 digits hold these products of counts below 10^16 exactly
EXACT = "cast(a as decimal(16,0)) * cast(n as decimal(16,0)) * cast(1000 as decimal(4,0)) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
FOUND = "lang string, phrase string, m int, n long, prefixes array<long>, partial boolean"


class Words(dict):
    """Numbers of the words of a part of the table, with a hash of each."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = number = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word.encode()))
        return number


def _suffixes(texts: list[str | None], words: Words, depth: int) -> np.ndarray:
    """Numbers of the words of all suffixes, one row each."""
    line: list[int] = []
    for text in texts:
        for piece in BREAKS.split((text or "").encode().lower().decode()):  # bytes: A-Z alone change
            found = BLANKS.findall(piece)
            if found:
                line.extend(map(words.__getitem__, found))
                line.append(EMPTY)
    flat = np.array(line, np.int64)
    out = np.full((len(flat), depth), EMPTY)
    for d in range(depth):
        out[:max(0, len(flat) - d), d] = flat[d:]
        if d:
            out[out[:, d - 1] == EMPTY, d] = EMPTY
    return out[flat != EMPTY]


def _prefix_hashes(rows: np.ndarray, words: Words, lang: str) -> np.ndarray:
    """Per suffix the hash of each of its prefixes, the language included; a column for each place."""
    import xxhash

    known = np.array([*words.hashes, 0], np.uint64)
    h, out = np.full(len(rows), xxhash.xxh64_intdigest(lang.encode(), 1), np.uint64), np.zeros(rows.shape, np.uint64)
    for d in range(rows.shape[1]):
        h = (h ^ known[rows[:, d]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        out[:, d] = h
    return out


def _batches(batches: Iterator[pa.RecordBatch], depth: int, flush: int = 1_000_000) -> Iterator[tuple[str, np.ndarray, Words]]:
    """Suffixes language by language, some ten megabytes of text at a time."""
    held: dict[str, list] = {}
    size = 0

    def out() -> Iterator[tuple[str, np.ndarray, Words]]:
        for lang, texts in held.items():
            words = Words()
            yield lang, _suffixes(texts, words, depth), words
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault("und" if lang is None else lang, []).append(text)
            size += len(text or "")
            if size > 8 * flush:
                yield from out()
                size = 0
    yield from out()


def prefix_counters(docs: DataFrame, depth: int) -> np.ndarray:
    """How often prefixes of each length are met, by hash: depth - 1 rows of a fixed number of counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((depth - 1, COUNTERS), np.int64)
        for lang, rows, words in _batches(batches, depth):
            hashes = _prefix_hashes(rows[:, :-1], words, lang)
            for d in range(depth - 1):
                counts[d] += np.bincount((hashes[:, d] >> np.uint64(48)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 12, pa.int64()), pa.array(at & 4095, pa.int64()), pa.array(counts.ravel()[at])], names=["slot", "place", "n"])

    found = docs.mapInArrow(run, "slot long, place long, n long").groupBy("slot", "place").agg(F.sum("n").alias("n"))
    out = np.zeros((depth - 1) * COUNTERS, np.int64)
    for slot, place, n in found.toLocalIterator():
        out[(slot << 12) + place] = n
    return out.reshape(depth - 1, COUNTERS)


def _deal(docs: DataFrame, depth: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Suffixes with their number, packed by bucket; ``hot`` tells of each prefix length which counters are too full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, rows, words in _batches(batches, depth):
            if not len(rows):
                continue
            order = np.lexsort(rows.T[::-1])
            rows = rows[order]
            first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
            weight, rows = np.diff(np.r_[first, len(rows)]), rows[first]
            hashes = _prefix_hashes(rows, words, lang)
            lead = np.ones(len(rows), np.int64)  # leading words that choose the bucket
            for d in range(depth - 1):
                lead += (lead == d + 1) & hot[d][(hashes[:, d] >> np.uint64(48)).astype(np.int64)]
            chosen = hashes[np.arange(len(rows)), lead - 1]
            bucket = ((chosen & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, weight, lead, bucket = rows[order], weight[order], lead[order], bucket[order]
            names = np.array([*words, ""], object)
            cuts = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(rows)]
            for part in range(0, len(cuts) - 1, 256):
                out = []
                for a, b in zip(cuts[part:part + 256], cuts[part + 1:part + 257], strict=False):
                    used, local = np.unique(rows[a:b], return_inverse=True)
                    own = used != EMPTY
                    local = local.reshape(-1, depth) - (not own.all())
                    out.append((int(bucket[a]), lang, "\n".join(names[used[own]]), local.astype("<i4").T.tobytes(), weight[a:b].astype("<i8").tobytes(), lead[a:b].astype(np.int8).tobytes()))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "lang", "words", "rows", "weights", "leads"])

    return docs.mapInArrow(run, "bucket long, lang string, words string, rows binary, weights binary, leads binary").repartition(buckets, "bucket")


def three_way(rows: np.ndarray, weight: np.ndarray, lead: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int, tuple[int, ...], bool]]:
    """Multikey quicksort of pointers to ``rows``: (words, count, counts of the shorter prefixes, whether other buckets have some)."""
    stack = [(np.arange(len(rows)), 0, (), ())]
    while stack:
        at, d, path, counts = stack.pop()
        column = rows[at, d]
        pivot = column[len(column) // 2]
        same = column == pivot
        for side in (at[column < pivot], at[column > pivot]):
            if len(side) and (weight[side].sum() >= least or (lead[side] > d + 1).any()):
                stack.append((side, d, path, counts))
        if pivot == EMPTY:  # these suffixes end before this place
            continue
        equal = at[same]
        n, partial = int(weight[equal].sum()), bool(lead[equal[0]] > d + 1)
        if n < least and not partial:
            continue
        yield (*path, int(pivot)), n, counts, partial
        if d + 1 < rows.shape[1]:
            stack.append((equal, d + 1, (*path, int(pivot)), (*counts, n)))


def _mine(dealt: DataFrame, depth: int, least: int) -> DataFrame:
    """Frequent phrases of each bucket, parts of those that several buckets share, and per language the number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for _, lang, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(lang, []).append(data)
        for lang, parts in held.items():
            names: dict[str, int] = {}
            rows, weights, leads = [], [], []
            for words, cells, weight, lead in parts:
                numbers = np.array([*(names.setdefault(w, len(names)) for w in words.split("\n")), EMPTY])
                rows.append(numbers[np.frombuffer(cells, "<i4").reshape(depth, -1).T])
                weights.append(np.frombuffer(weight, "<i8"))
                leads.append(np.frombuffer(lead, np.int8))
            rows, weights, leads = (np.concatenate(x) for x in (rows, weights, leads))
            spelled = list(names)
            found = [(lang, "", 0, int(weights.sum()), [], True)]
            for path, n, counts, partial in three_way(rows, weights, leads, least):
                found.append((lang, " ".join(spelled[w] for w in path), len(path), n, counts, partial))
                if len(found) == 20_000:
                    yield batch_of(found)
                    found = []
            yield batch_of(found)

    def batch_of(found: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_())
        columns = list(zip(*found, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["lang", "phrase", "m", "n", "prefixes", "partial"])

    return dealt.mapInArrow(run, FOUND)


def frequent_phrases(docs: DataFrame, depth: int = 5, least: int = 100, lang_col: str = "lang", text_col: str = "text",
                     bucket_entries: int = 1_000_000, group: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, a) of the phrases of 1 to ``depth`` words with at least ``least`` occurrences, and (lang, n)."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counters = prefix_counters(rows, depth)
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(counters[0].sum()) // bucket_entries)
    found = cut_lineage(_mine(_deal(rows, depth, buckets, counters > group), depth, least))
    shared = found.where("partial").groupBy("lang", "phrase", "m").agg(F.sum("n").alias("a"))
    phrases = found.where("not partial").select("lang", "phrase", "m", F.col("n").alias("a")).unionByName(shared.where((F.col("m") > 0) & (F.col("a") >= least)))
    return cut_lineage(phrases), shared.where("m = 0").select("lang", F.col("a").alias("n"))


def collocations(docs: DataFrame, top: int = 2000, depth: int = 5, least: int = 100, lang_col: str = "lang", text_col: str = "text",
                 bucket_entries: int = 1_000_000, group: int = 200_000) -> DataFrame:
    """Each language's best phrases of 2 to ``depth`` words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and at blanks into words.  ``a``, ``l`` and ``r``
    count the phrase and the two parts of its lowest-scoring cut (ties: the smallest first part), ``n`` the words of the
    language; the score is floor(1000 a n / (l r)).  A phrase within a longer one of the same count is left out.
    Best are the greatest score, then the greatest count, then the smallest phrase in byte order.

    A null lang is ``und``; null and empty texts have no words; repeated rows count each; whole texts of any length count;
    other columns are ignored; an empty table gives an empty result.
    """
    phrases, totals = frequent_phrases(docs, depth, least, lang_col, text_col, bucket_entries, group)
    words = phrases.where("m > 1").withColumn("w", F.split("phrase", " ", -1))
    piece = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = words.select("lang", "phrase", "m", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - 1), lambda k: F.struct(
        k.alias("k"), piece(F.lit(1), k).alias("first"), piece(k + 1, F.col("m") - k).alias("rest")))).alias("cut")).select("lang", "phrase", "m", "a", "cut.*")
    one = lambda c, n: phrases.select("lang", F.col("phrase").alias(c), F.col("a").alias(n))
    cuts = cut_lineage(cuts.join(one("first", "l"), ["lang", "first"]).join(one("rest", "r"), ["lang", "rest"]))
    # a longer phrase of the same count has one a word longer between it and the phrase, of that count too
    inner = cuts.where("k = 1 and r = a").select("lang", F.col("rest").alias("phrase")).unionByName(cuts.where("k = m - 1 and l = a").select("lang", F.col("first").alias("phrase"))).where("instr(phrase, ' ') > 0").distinct()
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(EXACT))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    best = best.join(inner, ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
