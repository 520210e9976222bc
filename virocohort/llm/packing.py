"""Sum-of-squares packing of documents into token sequences of one length.

Documents are cut only where they are longer than a sequence.  Pieces are dealt at random to packers; each
packer goes through its pieces from the longest down and puts a piece where the sum over all gaps of the squared
number of open bins with that gap becomes smallest (a new bin is one of the choices).  Bins that stay too empty are
dissolved and their pieces packed again, first by the same packer, then at the next level together with those of
other packers.  A packer holds lengths alone, never texts or ids, and about ``packer_pieces`` of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virocohort.llm.common import fresh
from virocohort.llm.tokens import encoder
from virocohort.session import cut_lineage

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cut_pieces(docs: DataFrame, tokenizer: str, split: str | None, end_id: int = 0, size: int = 2048,
               id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per piece: row, doc_id, piece, start, length, ids_crc32, and on request the ids (32-bit little-endian)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, split), int(end_id).to_bytes(4, "little")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            found = []
            texts = batch.column("text").cast(pa.binary())
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                data = encode(text.as_py()) + end
                for k in range(0, len(data), 4 * size):
                    part = data[k:k + 4 * size]
                    found.append((row, doc, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, in the order given, and the number of bins."""
    count = np.zeros(size + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        if n == size:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        # the change of the sum: a gap g becomes g - n, or vanishes where g = n; a new bin has the gap size - n
        change = np.where(count[n:size] > 0, 2 * (count[: size - n] - count[n:size]) + 2, never)
        if count[n]:
            change[0] = 1 - 2 * count[n]
        at = int(change.argmin())
        if change[at] > 2 * count[size - n] + 1:
            gap, b, made = size, made, made + 1
        else:
            gap = at + n
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, size - gap
        if gap > n:
            stacks[gap - n].append(b)
            count[gap - n] += 1
    return bins, offsets, made


def pack_lengths(lengths: np.ndarray, size: int, rounds: int, enough: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and level of the bin of each length, from the longest down in each round: bins that are filled to less
    than ``enough`` are dissolved and their pieces packed again."""
    bins, offsets, levels = (np.zeros(len(lengths), np.int64) for _ in range(3))
    at, made = np.argsort(-lengths, kind="stable"), 0
    for _ in range(rounds):
        b, o, m = sum_of_squares(lengths[at], size)
        level = np.bincount(b, lengths[at], m).astype(np.int64)
        bins[at], offsets[at], levels[at] = b + made, o, level[b]
        made += m
        at = at[level[b] < enough * size]
    return bins, offsets, levels


def _packer(size: int, rounds: int, enough: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        item, length, packer = (np.concatenate([b.column(c).to_numpy() for b in read]) for c in ("item", "length", "packer"))
        for p in np.unique(packer):
            at = np.flatnonzero(packer == p)
            bins, offsets, levels = pack_lengths(length[at], size, rounds, enough)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item[at], length[at], (p << 24) + bins, offsets, levels)],
                                             names=["item", "length", "bin", "offset", "level"])

    return pack


def pack_items(items: DataFrame, size: int, packer_pieces: int, rounds: int, enough: float) -> DataFrame:
    """Bins of (item, length): item, length, bin, offset, level."""
    packers = max(1, -(-items.count() // packer_pieces))
    dealt = items.withColumn("packer", F.pmod(F.xxhash64("item"), F.lit(packers)))
    dealt = dealt.repartition(packers, "packer").sortWithinPartitions("packer", "item").select("item", "length", "packer")
    return cut_lineage(dealt.mapInArrow(_packer(size, rounds, enough), "item long, length long, bin long, offset long, level long"))


def pack(pieces: DataFrame, size: int = 2048, packer_pieces: int = 30_000, rounds: int = 3, levels: int = 2, enough: float = 0.95) -> DataFrame:
    """Adds sequence_id and offset to pieces with a length; other columns are kept.

    Sequences are gapless from 0 and at most ``size`` long.  A packer dissolves the bins that it filled to less than
    ``enough`` and packs their pieces again, ``rounds`` times in all; at each further level the pieces of all packers' bins
    that are still below it are dealt anew, to fewer packers.
    """
    item = fresh(pieces, "item")
    pieces = cut_lineage(pieces.withColumn(item, F.monotonically_increasing_id()))
    todo, done = pieces.select(F.col(item).alias("item"), F.col("length").cast("long").alias("length")), None
    for level in range(levels):
        placed = pack_items(todo, size, packer_pieces, rounds, enough)
        last = level == levels - 1
        kept = (placed if last else placed.where(F.col("level") >= enough * size)).select(
            F.col("item").alias(item), (F.col("bin") * levels + level).alias("sequence_id"), "offset")
        done = kept if done is None else done.unionByName(kept)
        todo = placed.where(F.col("level") < enough * size).select("item", "length")
    return pieces.join(done, item).drop(item)


def pack_documents(docs: DataFrame, tokenizer: str, split: str | None, end_id: int = 0, size: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text", **packing) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Repeated rows and null ids are packed like any others; an empty
    table gives an empty result; other columns are ignored.
    """
    placed = pack(cut_pieces(docs, tokenizer, split, end_id, size, id_col, text_col).drop("ids"), size, **packing)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed ids: sequence_id, pieces, ids (32-bit little-endian).  ``placed`` has ids; a group is one sequence."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
    return parts.select("sequence_id", F.size("parts").alias("pieces"), F.expr("concat_ws('', transform(parts, p -> hex(p.ids)))").alias("hex")).select(
        "sequence_id", "pieces", F.unhex("hex").alias("ids"))


def fill(placed: DataFrame, size: int = 2048) -> DataFrame:
    """Sequences, tokens and the least number of sequences that could hold them."""
    return placed.agg(F.count_distinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens"), F.ceil(F.sum("length") / size).alias("least"))
