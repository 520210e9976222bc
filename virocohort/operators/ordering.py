"""Order along a contig without one task per contig.

A plain window over a genome puts every gene of it in one task.  Here the coordinate axis is cut
into bins: ranks and running totals are computed inside bins and shifted by the totals of earlier
bins (a table of one row per bin), and frames of a few neighbours are served from index blocks
that carry a copy of the rows just outside them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from virocohort.session import cut_lineage

AXIS_BIN = 20_000
INDEX_BLOCK = 1024


def running_total(df: DataFrame, keys: Sequence[str], axis: str, order: Sequence[str], value: Column,
                  name: str, size: float = AXIS_BIN, kind: str = "bigint") -> DataFrame:
    """Inclusive running sum of ``value`` per key in ``order``, whose first column is ``axis``.

    Rows with a null key or place are kept: nulls are a key, and the first place, of their own.
    """
    df = df.withColumn("__bin", F.floor(F.col(axis) / size)).withColumn("__v", value)
    totals = df.groupBy(*keys, "__bin").agg(F.sum("__v").alias("__t"))
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__bin"])], F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*keys, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__bin"])]
    return (
        df.withColumn("__r", F.sum("__v").over(inside))
        .join(offsets, same)
        .withColumn(name, (F.col("__o") + F.col("__r")).cast(kind))
        .drop("__bin", "__v", "__r", "__o", *[f"__k{i}" for i in range(len(keys) + 1)])
    )


def ordinal(df: DataFrame, keys: Sequence[str], axis: str, order: Sequence[str], name: str = "idx",
            size: int = AXIS_BIN) -> DataFrame:
    """0-based position per key in ``order``."""
    return running_total(df, keys, axis, order, F.lit(1), name, size).withColumn(name, F.col(name) - 1)


def global_rank(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based rank of each row in a total ``order`` of the whole table.

    The sort deals rows to ranges by splitters from a sample, so equal leading columns don't crowd a task; a row's rank is its
    place in its range plus the rows of the ranges before (a table of one row a range).
    """
    placed = cut_lineage(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__at", 33))  # the id's upper bits are the range, the others count its rows
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(before, "__range").withColumn(name, place.cast("bigint")).drop("__at", "__range", "__before")


def with_neighbours(df: DataFrame, keys: Sequence[str], idx: str, reach: int,
                    build: Callable[[Callable[[int, int], Window]], dict[str, Column]],
                    block: int = INDEX_BLOCK) -> DataFrame:
    """Columns computed over frames of at most ``reach`` rows either side of each row.

    ``build`` gets a factory of frames (lo, hi relative rows; ``frame(0, 0)`` without bounds is
    ``frame.ordered``) and returns the new columns.  Rows near a block edge are copied to the next
    block and dropped after the window has run.
    """
    slot = F.floor(F.col(idx) / block)
    here = F.col(idx) % block
    targets = F.array_compact(F.array(
        slot, F.when(here < reach, slot - 1), F.when(here >= block - reach, slot + 1)))
    spread = df.withColumn("__home", slot).withColumn("__blk", F.explode(targets))
    base = Window.partitionBy(*keys, "__blk").orderBy(idx)

    def frame(lo: int, hi: int) -> Window:
        return base.rowsBetween(lo, hi)

    frame.ordered = base
    for name, column in build(frame).items():
        spread = spread.withColumn(name, column)
    return spread.where(F.col("__blk") == F.col("__home")).drop("__home", "__blk")
