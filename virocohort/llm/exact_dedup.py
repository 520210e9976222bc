"""Exact dedup by a tree-merge of sorted digest runs.

Each input partition makes one sorted run of text digests.  Runs are exchanged in binomial rounds: a
slot's number is read in base ``fan``, and in round r the entries of a slot go to the slot whose r-th
digit is that of the digest.  Whatever meets is merged as sorted streams, and of equal digests one
entry survives at every level, the one that wins by code points, id and row.  After the last round each
digest sits in one slot.  A text that fills a third of the table is one entry per run from the start, so no
task ever holds a group; slots are as many as the entries need, so runs stay of bounded size.

Equality is that of SHA-256 together with the length in bytes, checked at every level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virocohort.session import cut_lineage

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
ENTRY = "origin long, slot long, digest binary, bytes long, points long, id long, row long, copies long"


def _order() -> list:
    """Equal digests side by side, the row that stays first."""
    return [F.col("digest"), F.col("bytes"), F.col("points").desc(), F.col("id").asc_nulls_last(), F.col("row")]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        bare = [(t or b"").translate(None, BLANKS) for t in text.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("id"), pa.array([hashlib.sha256(t).digest() for t in bare], pa.binary()),
             pa.array([len(t) for t in bare], pa.int64()), pc.fill_null(pc.utf8_length(text), 0).cast(pa.int64())],
            names=["row", "id", "digest", "bytes", "points"])


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row its number, id, digest of the text without blanks, bytes without blanks and code points."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests, "row long, id long, digest binary, bytes long, points long")


def _merge(by_origin: bool):
    """Streams entries in that order and keeps the first of each key with the sum of copies."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)  # all columns nullable
            if held is not None:
                batch = pa.concat_batches([held, batch])
            if not batch.num_rows:
                continue
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "V32")
            size = batch.column("bytes").to_numpy()
            first = np.ones(batch.num_rows, bool)
            first[1:] = (digest[1:] != digest[:-1]) | (size[1:] != size[:-1])
            for name in ("slot", "origin")[: 1 + by_origin]:
                key = batch.column(name).to_numpy()
                first[1:] |= key[1:] != key[:-1]
            at = np.flatnonzero(first)
            copies = np.add.reduceat(batch.column("copies").to_numpy(), at)
            kept = batch.take(pa.array(at))
            kept = kept.set_column(kept.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))
            if len(at) > 1:
                yield kept.slice(0, len(at) - 1)
            held = kept.slice(len(at) - 1)
        if held is not None:
            yield held

    return merge


def local_runs(digests: DataFrame, slots: int) -> DataFrame:
    """One sorted run of distinct entries for each input partition (the origin, in the row number's upper bits)."""
    entries = digests.select(
        F.shiftright("row", 33).alias("origin"), F.pmod(F.shiftright("row", 33), F.lit(slots)).alias("slot"),
        "digest", "bytes", "points", "id", "row", F.lit(1).cast("long").alias("copies"))
    return entries.sortWithinPartitions("origin", *_order()).mapInArrow(_merge(True), ENTRY)


def tree_merge(runs: DataFrame, fan: int, rounds: int) -> DataFrame:
    """Binomial rounds of exchange and multiway merge; one entry per digest is left."""
    slots = fan**rounds
    goal = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long") % slots
    for r in range(rounds):
        unit = fan**r
        digit = lambda c: F.floor(c / unit).cast("long") % fan  # noqa: B023, E731  used at once
        place = F.col("slot") + (digit(goal) - digit(F.col("slot"))) * unit
        runs = (runs.withColumn("slot", place.cast("long")).select(*[c.split()[0] for c in ENTRY.split(", ")])
                .repartition(slots, "slot").sortWithinPartitions("slot", *_order()).mapInArrow(_merge(False), ENTRY))
    return runs


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
                fan: int = 4, run_rows: int = 16384) -> DataFrame:
    """One row per input row: row, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without ASCII blanks; null counts as empty.  The longest original in
    code points stays, then the smallest id (a null id after all others), then the first row; of repeated
    rows with one id exactly one is kept.  An empty table gives an empty result; other columns are ignored.
    ``row_col`` names a number that tells rows apart and has the input partition in its bits above 33; by
    default one is made.  ``run_rows`` is the aimed size of a merged run, ``fan`` the runs merged per round.
    """
    digests = cut_lineage(digest_rows(docs, id_col, text_col, row_col))
    rounds, entries = 1, digests.count()
    while fan**rounds * run_rows < entries:
        rounds += 1
    runs = local_runs(digests, fan**rounds)
    best = tree_merge(runs, fan, rounds).select(
        "digest", "bytes", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size"))
    # an origin that is read in several splits has a run, and an entry of a digest, for each
    per_run = runs.select("origin", "digest", "bytes").distinct().join(best, ["digest", "bytes"])
    return (digests.withColumn("origin", F.shiftright("row", 33)).join(per_run, ["origin", "digest", "bytes"])
            .select("row", F.col("id").alias("doc_id"), "keep_id", "group_size",
                    (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")))
