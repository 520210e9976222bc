"""Sequential matching rules run over sorted blocks, with the same outcome as the walk over everything."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from virocohort.session import cut_lineage, release

BLOCK_ROWS = 200_000
FREE, OPEN, TAKEN = range(3)


def _settle(edges: DataFrame, place: Sequence[str], mark: Callable[[DataFrame], DataFrame], order: Sequence, carried: Sequence[str],
            walk: Callable[[Iterator[tuple]], Iterator[tuple]], block_rows: int) -> DataFrame:
    """Rounds over blocks of consecutive ``p``: range partitions by genome and ``place``, so a genome of any size has many.

    ``mark`` tells of an edge (column ``open``) that other blocks may still decide about it.  ``walk`` gets the rows (p, d, open,
    *carried) of one genome in one block in ``order`` and gives (p, d, free, overlap) for each ``p`` whose outcome can't change any
    more.  Those, and the edges of each ``d`` taken, go; what is left depends on a block's border and is dealt out anew, into fewer
    blocks.  A chain of choices therefore takes a round for each block that it spans, not for each choice.
    """
    kinds = {f.name: f.dataType for f in edges.schema}
    told = T.StructType([T.StructField("genome_id", kinds["genome_id"]), T.StructField("p", kinds["p"]), T.StructField("d", kinds["d"]),
                         T.StructField("free", T.LongType()), T.StructField("overlap", kinds.get("overlap", T.LongType()))])
    columns = ["block", "genome_id", "p", "d", "open", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                if not types:
                    field = batch.schema.field
                    types.extend([field("genome_id").type, field("p").type, field("d").type, pa.int64(), field("overlap").type if "overlap" in carried else pa.int64()])
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def packed(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=told.names)

        out = []
        for (_, genome), group in groupby(rows(), key=itemgetter(0, 1)):
            for decided in walk(row[2:] for row in group):
                out.append((genome, *decided))
                if len(out) == 1 << 14:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    edges = cut_lineage(edges)
    blocks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = []
    while rows := edges.count():
        n = max(math.ceil(rows / block_rows), 1 if settled else blocks)
        dealt = cut_lineage(edges.repartitionByRange(n, "genome_id", *place).withColumn("block", F.spark_partition_id()))
        walked = mark(dealt).select(*columns, *[F.col(o).alias(f"__{i}") for i, o in enumerate(order)]).repartition(n, "block")
        keys = [F.col(f"__{i}").asc() if o in place else F.col(f"__{i}").desc() for i, o in enumerate(order)]
        new = cut_lineage(walked.sortWithinPartitions("block", "genome_id", *keys).select(*columns).mapInArrow(run, told))
        settled.append(new)
        left = cut_lineage(edges.join(new.select("genome_id", "p"), ["genome_id", "p"], "left_anti").join(
            new.where("d is not null").select("genome_id", "d"), ["genome_id", "d"], "left_anti"))
        release(dealt)
        release(edges)
        edges = left
    return reduce(DataFrame.unionByName, settled) if settled else edges.sparkSession.createDataFrame([], told)


def _earlier_blocks(dealt: DataFrame) -> DataFrame:
    """An edge is open while a block before its own has an undecided ``p`` with the same ``d``."""
    first = dealt.groupBy("genome_id", "d").agg(F.min("block").alias("first_block"))
    return dealt.join(first, ["genome_id", "d"]).withColumn("open", F.col("first_block") < F.col("block"))


def ordered_choice(edges: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each ``p``, in ``turn`` order, takes its most preferred free ``d``; a choice that does not fit
    uses nothing up.

    Edges: genome_id, p, d, turn (a total order of ``p``), pref, fits, overlap; of them and ``block_rows`` (rows of one task) only
    the former decide the result.
    """
    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        state: dict = {}
        for p, own in groupby(rows, key=itemgetter(0)):
            waits, choice = False, None
            for _, d, open_, fits, overlap in own:
                seen = state.get(d, OPEN if open_ else FREE)
                if seen == FREE:
                    choice = (d, fits, overlap)
                    break
                waits |= seen == OPEN
            if choice and waits:  # one before it may stay free for p, or this one is chosen: later ones can't count on it
                state[choice[0]] = OPEN
            elif choice and choice[1]:
                state[choice[0]] = TAKEN
                yield p, choice[0], 1, choice[2]
            elif choice:
                yield p, None, 0, None

    found = _settle(edges, ["turn", "p"], _earlier_blocks, ["turn", "p", "pref"], ["fits", "overlap"], walk, block_rows)
    return found.where("d is not null").select("genome_id", "p", "d", "overlap")


def single_choice(edges: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each ``p``, in ``turn`` order, takes its free ``d`` if it has exactly one; result: genome_id, p, free (how many were
    free at its turn), d (the one taken, else null).  A ``p`` whose partners were all taken before its turn is left out.

    Edges: genome_id, p, d, turn (a total order of ``p``).
    """
    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        state: dict = {}
        for p, own in groupby(rows, key=itemgetter(0)):
            left = {d: state.get(d, OPEN if open_ else FREE) for _, d, open_ in own}
            left = {d: seen for d, seen in left.items() if seen != TAKEN}
            if OPEN in left.values():
                state.update(dict.fromkeys(left, OPEN))
            elif len(left) == 1:
                state.update(dict.fromkeys(left, TAKEN))
                yield p, next(iter(left)), 1, None
            elif left:
                yield p, None, len(left), None

    edges = edges.select("genome_id", "p", "d", "turn")
    return _settle(edges, ["turn", "p"], _earlier_blocks, ["turn", "p"], [], walk, block_rows).select("genome_id", "p", "free", "d")


def mutual_best(edges: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """MT04: one-to-one pairs (genome_id, p, d) by descending ``rank``, as if edges were sorted and taken while free.

    Edges: genome_id, p, d, rank (a total order), place (where ``p`` lies, so that blocks share few ``d``).  An edge is taken in its
    block when no undecided edge of a higher rank is left at either end; a ``d`` with edges in several blocks waits for its highest.
    """
    def mark(dealt: DataFrame) -> DataFrame:
        top = dealt.groupBy("genome_id", "d").agg(F.max("rank").alias("top"), (F.min("block") < F.max("block")).alias("wide"))
        return dealt.join(top, ["genome_id", "d"]).withColumn("open", F.col("wide") & (F.col("rank") < F.col("top")))

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        left: dict = {}
        right: dict = {}
        for p, d, open_ in rows:
            ends = left.get(p, FREE), right.get(d, FREE)
            if TAKEN in ends:
                continue
            if open_ or OPEN in ends:
                left[p] = right[d] = OPEN
            else:
                left[p] = right[d] = TAKEN
                yield p, d, 1, None

    edges = edges.select("genome_id", "p", "d", "rank", "place")
    return _settle(edges, ["place", "p"], mark, ["rank"], [], walk, block_rows).select("genome_id", "p", "d")


def surviving_choice(options: DataFrame, threats: DataFrame) -> DataFrame:
    """Items, in order, are taken while one of their options survives, and a taken item removes options of later ones.

    ``options``: item, opt.  ``threats``: item, opt, earlier (an item before it whose being taken removes the option).
    Result: the taken items.  Each round takes every item with an option that nothing undecided threatens any more, which
    holds for the first undecided item of every chain; there are as many rounds as the longest chain of undecided threats.
    """
    options, threats = cut_lineage(options), cut_lineage(threats)
    taken = [options.where("false").select("item")]
    while not options.isEmpty():
        safe = cut_lineage(options.join(threats, ["item", "opt"], "left_anti").select("item").distinct())
        taken.append(safe)
        lost = threats.join(safe.select(F.col("item").alias("earlier")), "earlier", "left_semi").select("item", "opt")
        left = cut_lineage(options.join(safe, "item", "left_anti").join(lost, ["item", "opt"], "left_anti"))
        undecided = left.select(F.col("item").alias("earlier")).distinct()
        kept = cut_lineage(threats.join(left, ["item", "opt"], "left_semi").join(undecided, "earlier", "left_semi").select("item", "opt", "earlier"))
        release(options)
        release(threats)
        options, threats = left, kept
    return reduce(DataFrame.unionByName, taken)


def walk_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], walk: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """Apply an order-dependent rule to each key's rows, streamed in sorted order.

    Rows arrive as Arrow batches of a sorted partition and only the current key is held, so many
    small groups cost no per-group call and no partition is loaded whole.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    out += walk(held) if held else []
                    current, held = key, []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(walk(held), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
