"""Spelling variants: words at one edit, found by probing generated edits against Bloom filters.

Words of the vocabulary fill blocked Bloom filters, one shard for each word length: a word's hash names one block of 512 bits,
and its bits lie within that block.  Each word's edits probe the shards of their lengths: all deletions, and replacements by a
greater letter.  Insertions and other replacements are the same pairs seen from the other word, so they need no probe of
their own.  An edit's hash follows from the word's prefix sums without building the edited word.  Only positives are
written out and shuffled to an exact join with the vocabulary, which removes the false ones.

A broadcast never exceeds ``filter_bytes``: shards that don't fit together go in several passes, and a shard that alone
doesn't fit is passed in ranges of its blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virocohort.session import cut_lineage, release

RUN = "[A-Za-zÀ-ÿ]+"
BITS = 512
PROBES = 6
STEP = 0xD6E8FEB86659FD93  # odd: weight of a place is its power


def _count_words(docs: DataFrame, least: int, every: int, flush: int = 300_000) -> DataFrame:
    """Occurrences of the (perhaps shortened) runs of each part of the table, long ones alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(RUN[:-1] + f"{{{least},}}")  # shorter ones give no word, with or without a deletion
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = Counter(runs.findall((text or "").encode().lower().decode()))  # bytes: A-Z alone change
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    counts[word] += n
                if len(counts) > flush:
                    yield out()
        yield out()

    return docs.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, least: int = 6, often: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words (word, length, n) of at least ``least`` code points and ``often`` occurrences in all texts."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _count_words(rows, least, every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often).select("word", F.length("word").cast("long").alias("length"), "n")


def _letter(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value of each code point."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)


def _hashes(codes: np.ndarray) -> np.ndarray:
    return _mixed((_letter(codes) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64))


def _spots(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits within it (a mask of eight 64-bit words would be wider: bits are probed one by one)."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits = np.stack([(_mixed(h + np.uint64(k)) >> np.uint64(55)) for k in range(1, PROBES + 1)])
    return block.astype(np.int64), bits.astype(np.int64)


def build_filters(words: DataFrame, plan: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int, np.ndarray]]:
    """Bloom filters of lengths as the plan's (length, blocks of the shard, first block, end block) name them.

    Tasks fill their part, and parts of a block range are joined by ``or`` before they reach the driver, so it takes no
    more than the filters' own bytes.
    """
    piece = 1 << 12  # blocks of a row that tasks exchange
    wanted = {length: rest for length, *rest in plan}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            length = batch.column("length").to_numpy()
            for size in np.unique(length):
                blocks, lo, hi = wanted[int(size)]
                h = _hashes(_codes(batch.column("word").filter(pa.array(length == size)).to_pylist(), int(size)))
                block, bits = _spots(h, blocks)
                mine = (block >= lo) & (block < hi)
                block, bits = block[mine] - lo, bits[:, mine]
                for part in np.unique(block // piece):
                    if (int(size), int(part)) not in own:
                        own[int(size), int(part)] = np.zeros((piece, BITS // 8), np.uint8)
                    at = block // piece == part
                    for k in range(PROBES):
                        b = bits[k, at]
                        np.bitwise_or.at(own[int(size), int(part)], (block[at] % piece, b >> 3), (1 << (b & 7)).astype(np.uint8))
        for (size, part), bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([part], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["length", "part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, part, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                met = np.frombuffer(bits, np.uint8)
                own[size, part] = own[size, part] | met if (size, part) in own else met
        for (size, part), bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([part], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["length", "part", "bits"])

    schema = "length long, part long, bits binary"
    chosen = words.where(F.col("length").isin(list(wanted))).select("word", "length")
    filters = {length: (blocks, lo, np.zeros((hi - lo, BITS // 8), np.uint8)) for length, blocks, lo, hi in plan}
    for length, part, bits in chosen.mapInArrow(fill, schema).repartition("length", "part").mapInArrow(join, schema).toLocalIterator():
        to = filters[length][2][part * piece:(part + 1) * piece]
        to |= np.frombuffer(bits, np.uint8).reshape(piece, -1)[:len(to)]
    return filters


def passes(counts: dict[int, int], filter_bytes: int, bits_per_word: int = 12) -> list[list[tuple[int, int, int, int]]]:
    """Shards of word lengths, and ranges of blocks of too large ones, dealt to passes of at most ``filter_bytes``."""
    room = max(1, filter_bytes // (BITS // 8))
    out: list[list[tuple[int, int, int, int]]] = [[]]
    free = room
    for length, words in sorted(counts.items()):
        blocks = max(1, -(-words * bits_per_word // BITS))
        for lo in range(0, blocks, room):
            hi = min(blocks, lo + room)
            if hi - lo > free:
                out.append([])
                free = room
            out[-1].append((length, blocks, lo, hi))
            free -= hi - lo
            if any(x[0] == length for x in out[-1][:-1]):  # one range of a length a pass
                out.append([out[-1].pop()])
                free = room - (hi - lo)
    return [p for p in out if p]


def _probe(words: DataFrame, filters: dict[int, tuple[int, int, np.ndarray]], letters: np.ndarray, probes: int = 1 << 19) -> DataFrame:
    """(word, edit): the edits of words that the filters may hold."""
    value = _letter(letters)

    def hits(h: np.ndarray, length: int) -> np.ndarray:
        blocks, lo, data = filters[length]
        block, bits = _spots(h, blocks)
        at = np.flatnonzero((block >= lo) & (block < lo + len(data)))
        for k in range(PROBES):
            at = at[(data[block[at] - lo, bits[k, at] >> 3] >> (bits[k, at] & 7).astype(np.uint8)) & 1 > 0]
        return at

    def edits(words: list[str], length: int) -> Iterator[tuple[str, str]]:
        codes = _codes(words, length)
        power = _powers(length + 1)
        own = _letter(codes)
        parts = own * power[:length]
        total = parts.sum(axis=1, dtype=np.uint64)
        if length - 1 in filters and length > 1:
            # what stands after a deleted letter moves down one place
            before = np.cumsum(parts, axis=1, dtype=np.uint64) - parts
            moved = own[:, 1:] * power[:length - 1]
            after = np.zeros_like(parts)
            after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
            h = _mixed(before + after)
            first = np.ones(codes.shape, bool)
            first[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of equal neighbours one deletion
            w, p = np.nonzero(first)
            for at in hits(h[w, p], length - 1):
                yield words[w[at]], words[w[at]][:p[at]] + words[w[at]][p[at] + 1:]
        if length in filters:
            for p in range(length):
                base = total - parts[:, p]
                w, c = np.nonzero(letters[None, :] > codes[:, p, None])
                for at in hits(_mixed(base[w] + value[c] * power[p]), length):
                    yield words[w[at]], words[w[at]][:p] + chr(letters[c[at]]) + words[w[at]][p + 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list[str]] = {}
            for word in batch.column("word").to_pylist():
                held.setdefault(len(word), []).append(word)
            for length, same in held.items():
                step = max(1, probes // (length * max(1, len(letters))))
                for at in range(0, len(same), step):
                    found = list(edits(same[at:at + step], length))
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=["word", "edit"])

    return words.select("word").mapInArrow(run, "word string, edit string")


def near_pairs(words: DataFrame, filter_bytes: int = 32 << 20) -> DataFrame:
    """Each unordered pair of words at one edit once: u, v, nu, nv.  ``words``: a written table of word, length, n."""
    counts = {r.length: r.words for r in words.groupBy("length").agg(F.count("*").alias("words")).collect()}
    letters = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()), np.int64)
    found = words.sparkSession.createDataFrame([], "word string, edit string")
    for plan in passes(counts, filter_bytes):
        filters = build_filters(words, plan)
        lengths = sorted({x for length, *_ in plan for x in (length, length + 1)})
        found = found.unionByName(cut_lineage(_probe(words.where(F.col("length").isin(lengths)), filters, letters)))
    exact = words.select(F.col("word").alias("edit"), F.col("n").alias("nv"))
    own = words.select("word", F.col("n").alias("nu"))
    return found.join(exact, "edit").join(own, "word").select(F.col("word").alias("u"), F.col("edit").alias("v"), "nu", "nv")


def follow(forms: DataFrame, word: str = "word", form: str = "form") -> DataFrame:
    """(word, root): the end of each chain of forms by pointer doubling, so rounds grow with the logarithm of its length."""
    links = cut_lineage(forms.select(F.col(word).alias("word"), F.col(form).alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        release(links)
        links = moved
        if links.where("moved").isEmpty():
            return links.select("word", "root")


def variants(docs: DataFrame, least: int = 6, often: int = 5, ratio: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = 32 << 20) -> DataFrame:
    """Spelling variants of the words of all texts: word, form, root, n, n_near, form_n.

    A word is a maximal run of Latin letters (A-Z lower-cased) of at least ``least`` code points that occurs ``often`` times.
    Of the runs, those whose crc32 with the document's id is divisible by ``every`` lose a letter.  ``form`` is the most frequent
    word at one edit (ties: smallest in code-point order) if it occurs ``ratio`` times as often, ``root`` the end of the
    chain of forms, ``n_near`` the number of words at one edit.

    A null text has no words and a null id is written as nothing; repeated rows and ids count each; texts and words may
    have any length; other columns are ignored; no words give an empty table.
    """
    words = cut_lineage(vocabulary(docs, least, often, every, id_col, text_col))
    pairs = near_pairs(words, filter_bytes)
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("near"), F.col("nv").alias("near_n")).unionByName(pairs.select(F.col("v").alias("word"), F.col("u").alias("near"), F.col("nu").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("b"))
    found = words.join(best, "word", "left")
    close = F.col("b.near_n") >= ratio * F.col("n")
    found = cut_lineage(found.select("word", F.when(close, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, F.col("b.near_n")).alias("form_n")))
    roots = follow(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
