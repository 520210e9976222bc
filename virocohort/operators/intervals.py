"""Interval operators on 1-based inclusive coordinates.

Every join here is an equi-join on (keys, coordinate bin).  A genome that holds a large share of
the rows is therefore spread over as many tasks as it has bins, and the pair is kept only in the
bin of the later start, so no ``distinct`` follows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from decimal import Context, Decimal
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BIN = 1000


def length(start: Column, end: Column) -> Column:
    return end - start + 1


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared positions of two intervals, never negative."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def bin_of(position: Column, size: int) -> Column:
    return F.floor((position - 1) / size)


def explode_bins(df: DataFrame, start: str, end: str, size: int = DEFAULT_BIN, name: str = "bin") -> DataFrame:
    """One row per coordinate bin an interval touches."""
    return df.where(F.col(end) >= F.col(start)).withColumn(
        name, F.explode(F.sequence(bin_of(F.col(start), size), bin_of(F.col(end), size)))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_interval: tuple[str, str],
    right_interval: tuple[str, str],
    size: int = DEFAULT_BIN,
    slack: int = 0,
) -> DataFrame:
    """IV01: pairs of rows with equal keys whose intervals share a position.

    ``slack`` widens the test: pairs up to that many positions apart are also returned (their
    ``overlap`` is 0).  Columns other than the keys must have different names on the two sides.
    """
    ls, le = left_interval
    rs, re = right_interval
    a = left.withColumn("__hi", F.col(le) + slack)
    a = explode_bins(a, ls, "__hi", size, "__bin")
    b = explode_bins(right, rs, re, size, "__bin")
    if slack:
        # the left interval is widened on both sides; bins below 0 are harmless
        a = left.withColumn("__lo", F.col(ls) - slack).withColumn("__hi", F.col(le) + slack)
        a = explode_bins(a, "__lo", "__hi", size, "__bin")
    lo = F.col("__lo") if slack else F.col(ls)
    joined = a.join(b, [*keys, "__bin"]).where(
        (lo <= F.col(re))
        & (F.col("__hi") >= F.col(rs))
        & (F.col("__bin") == bin_of(F.greatest(lo, F.col(rs)), size))
    )
    joined = joined.withColumn("overlap", overlap(F.col(ls), F.col(le), F.col(rs), F.col(re)))
    return joined.drop("__bin", "__hi", "__lo")


def suffixed(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rename every column but ``keep`` so both sides of a self-join stay addressable."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


def self_overlap(df: DataFrame, keys: Sequence[str], id_col: str, start: str = "s", end: str = "e",
                 size: int = DEFAULT_BIN) -> DataFrame:
    """Unordered overlapping pairs of one table, smaller id on the left."""
    a, b = suffixed(df, "_a", keys), suffixed(df, "_b", keys)
    pairs = overlap_join(a, b, keys, (start + "_a", end + "_a"), (start + "_b", end + "_b"), size)
    return pairs.where(F.col(id_col + "_a") < F.col(id_col + "_b"))


def reciprocal(shared: Column, len_a: Column, len_b: Column) -> Column:
    return F.least(shared / len_a, shared / len_b)


def meaningful(shared: Column, len_a: Column, len_b: Column, min_bp: int = 30, min_reciprocal: float = 0.5,
               floor: float = 0.1) -> Column:
    """IV02: enough shared bases with a fractional floor, or a large reciprocal share."""
    share = reciprocal(shared, len_a, len_b)
    return (shared > 0) & (((shared >= min_bp) & (share >= floor)) | (share >= min_reciprocal))


def max_overlap(df: DataFrame, keys: Sequence[str], id_col: str, start: str = "s", end: str = "e",
                size: int = DEFAULT_BIN) -> DataFrame:
    """IV03: largest overlap of each row with any other row of the same keys, 0 if none."""
    a, b = suffixed(df.select(*keys, id_col, start, end), "_a", keys), suffixed(df.select(*keys, id_col, start, end), "_b", keys)
    best = (
        overlap_join(a, b, keys, (start + "_a", end + "_a"), (start + "_b", end + "_b"), size)
        .where(F.col(id_col + "_a") != F.col(id_col + "_b"))
        .groupBy(*keys, F.col(id_col + "_a").alias(id_col))
        .agg(F.max("overlap").alias("max_overlap"))
    )
    return df.join(best, [*keys, id_col], "left").withColumn("max_overlap", F.coalesce("max_overlap", F.lit(0)))


def covered_length(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e",
                   size: int = 4096) -> DataFrame:
    """IV12: positions covered by at least one interval, per key.

    Intervals are clipped to bins, which makes bins independent.  Inside a bin only the furthest end
    per clipped start matters, so at most ``size`` rows reach the running maximum whatever the depth.
    """
    lo = F.col("__bin") * size + 1
    clipped = (
        explode_bins(df, start, end, size, "__bin")
        .select(*keys, "__bin", F.greatest(F.col(start), lo).alias("__s"), F.least(F.col(end), lo + (size - 1)).alias("__e"))
        .groupBy(*keys, "__bin", "__s")
        .agg(F.max("__e").alias("__e"))
    )
    before = Window.partitionBy(*keys, "__bin").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("__e") - F.greatest(F.coalesce(F.max("__e").over(before), F.col("__s") - 1), F.col("__s") - 1))
    return clipped.withColumn("__new", fresh).groupBy(*keys).agg(F.sum("__new").cast("bigint").alias("covered"))


def uncovered_length(candidates: DataFrame, occupied: DataFrame, keys: Sequence[str], id_col: str,
                     interval: tuple[str, str], occupied_interval: tuple[str, str],
                     size: int = DEFAULT_BIN) -> DataFrame:
    """IV14: positions of each candidate that no occupied interval touches."""
    s, e = interval
    os_, oe = occupied_interval
    hits = overlap_join(candidates.select(*keys, id_col, s, e), occupied.select(*keys, os_, oe), keys, (s, e), (os_, oe), size)
    clipped = hits.select(*keys, id_col, F.greatest(s, os_).alias("__cs"), F.least(e, oe).alias("__ce"))
    covered = covered_length(clipped, [*keys, id_col], "__cs", "__ce")
    return (
        candidates.join(covered, [*keys, id_col], "left")
        .withColumn("uncovered", (length(F.col(s), F.col(e)) - F.coalesce("covered", F.lit(0))).cast("bigint"))
        .drop("covered")
    )


def with_next(points: DataFrame, keys: Sequence[str], point: str, name: str, size: int = 20_000) -> DataFrame:
    """The next greater point of the same keys (null after the last), without one task per key.

    Neighbours within an axis bin come from the bin; the last of a bin looks at the first point of the next bin that has one.
    """
    bins = points.withColumn("__bin", F.floor(F.col(point) / size))
    first = bins.groupBy(*keys, "__bin").agg(F.min(point).alias("__first"))
    first = first.withColumn("__next", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__bin"))).drop("__first")
    inside = bins.withColumn(name, F.lead(point).over(Window.partitionBy(*keys, "__bin").orderBy(point)))
    return inside.join(first, [*keys, "__bin"]).withColumn(name, F.coalesce(name, "__next")).drop("__bin", "__next")


def dyadic_blocks(start: Column, end: Column) -> Column:
    """Aligned blocks (level, block: positions block * 2^level and the next 2^level) that tile start..end: two a level at most."""
    size = end - start + 1
    power = lambda n: F.pow(F.lit(2.0), n).cast("bigint")

    def at(level: Column) -> Column:
        lo, hi = F.ceil(start / power(level)).cast("bigint"), F.floor((end + 1) / power(level)).cast("bigint")
        block = lambda b: F.struct(level.cast("int").alias("level"), b.alias("block"))
        return F.array(F.when((lo < hi) & (lo % 2 == 1), block(lo)), F.when((lo < hi) & (hi % 2 == 1), block(hi - 1)))

    levels = F.sequence(F.lit(0), F.floor(F.log2(size.cast("double"))).cast("int") + 1)
    return F.array_compact(F.flatten(F.transform(levels, at)))


def _best_of_bin(rows: Iterable[tuple]) -> tuple[int, int]:
    """Identity in units of 10^-18 and bases of one bin's alignments (start, end, score, qs, qe, aln_len, nident) in order of start.

    ``waiting`` holds alignments that may still be the best of a base: the worst first, each reaching further than the better ones,
    so it is no longer than the bin.
    """
    identical = bases = at = 0
    waiting: list[tuple] = []

    def settle(until: int | None) -> None:
        nonlocal identical, bases, at
        while waiting and (until is None or at < until):
            (*_, aln_len, nident), end = waiting[-1]
            last = end if until is None else min(end, until - 1)
            if last >= at:
                n = last - at + 1
                identical += (2 * n * max(nident, 0) * 10**18 + aln_len) // (2 * aln_len)
                bases += n
                at = last + 1
            if end < at:
                waiting.pop()

    for start, end, score, qs, qe, aln_len, nident in rows:
        settle(start)
        at = start
        place = (0, 0.0) if score is None else (2, 0.0) if score != score else (1, score)
        rank = (place, qs, qe, aln_len, -1 if nident is None else nident)
        i = bisect_left(waiting, rank, key=itemgetter(0))
        if i < len(waiting) and waiting[i][1] >= end:
            continue
        low = i
        while low and waiting[low - 1][1] <= end:
            low -= 1
        waiting[low:i] = [(rank, end)]
    settle(None)
    return identical, bases


def best_hsp_per_base(hsps: DataFrame, keys: Sequence[str], size: int = 4096) -> DataFrame:
    """IV16: every query base belongs to its best alignment; identity and coverage per key.

    Input columns: qs, qe (ordered), aln_len, nident, score.  Ties fall to the larger start, end,
    length and identical count.

    Alignments are clipped to coordinate bins, which makes bins independent; of equal clipped extents the best is kept before
    a bin meets, so a bin has a bounded number of rows whatever the depth.  A bin is swept once in order of start.  Identity is added
    up in decimals, so it does not depend on the order of the rows.
    """
    keys = list(keys)
    real = explode_bins(hsps.where(F.col("aln_len") > 0), "qs", "qe", size, "__bin")
    lo = F.col("__bin") * size + 1
    rank = F.struct(F.col("score").cast("double").alias("score"), "qs", "qe", F.col("aln_len").cast("bigint").alias("aln_len"), F.col("nident").cast("bigint").alias("nident"))
    clipped = real.select(*keys, "__bin", F.greatest(F.col("qs"), lo).alias("__s"), F.least(F.col("qe"), lo + (size - 1)).alias("__e"), rank.alias("h"))
    best = clipped.groupBy(*keys, "__bin", "__s", "__e").agg(F.max("h").alias("h"))
    kinds = {f.name: f.dataType for f in hsps.schema}
    told = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField("identical", T.DecimalType(38, 18)), T.StructField("bases", T.LongType())])
    exact = Context(prec=38)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                if not types:
                    types.extend([*[batch.schema.field(k).type for k in keys], pa.decimal128(38, 18), pa.int64()])
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def packed(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=told.names)

        out, n = [], len(keys)
        for group, of_bin in groupby(rows(), key=lambda r: r[:n + 1]):
            identical, bases = _best_of_bin(r[n + 1:] for r in of_bin)
            out.append((*group[:n], exact.scaleb(Decimal(identical), -18), bases))
            if len(out) == 1 << 14:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    swept = best.select(*keys, "__bin", "__s", "__e", "h.*").repartition(*keys, "__bin").sortWithinPartitions(*keys, "__bin", "__s").mapInArrow(run, told)
    return swept.groupBy(*keys).agg(F.sum("identical").cast("double").alias("identical"), F.sum("bases").alias("aligned_bases"))


def overlap_kind(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """IV13: how the right interval (start-ordered after the left) meets the left one."""
    return (
        F.when(rs > le, "none")
        .when(rs == le, "shared_boundary")
        .when(re <= le, "nested_overlap")
        .otherwise("partial_overlap")
    )


def neighbour_overlaps(df: DataFrame, keys: Sequence[str], id_col: str, start: str = "s", end: str = "e",
                       strand: str = "strand", size: int = DEFAULT_BIN) -> DataFrame:
    """IV13: typed overlaps between pairs ordered by (start, end, strand, id)."""
    pairs = self_overlap(df, keys, id_col, start, end, size)
    order = lambda x: F.struct(F.col(start + x), F.col(end + x), F.col(strand + x), F.col(id_col + x))
    first = order("_a") <= order("_b")
    pick = lambda name, flip: F.when(~first if flip else first, F.col(name + "_a")).otherwise(F.col(name + "_b"))
    sides = pairs.select(
        *keys,
        pick(id_col, False).alias("left_id"), pick(id_col, True).alias("right_id"),
        pick(start, False).alias("ls"), pick(end, False).alias("le"),
        pick(start, True).alias("rs"), pick(end, True).alias("re"),
        (F.col(strand + "_a") == F.col(strand + "_b")).alias("same_strand"),
    )
    kind = overlap_kind(F.col("ls"), F.col("le"), F.col("rs"), F.col("re"))
    return sides.select(
        *keys, "left_id", "right_id", kind.alias("overlap_type"),
        (F.col("le") - F.col("rs") + 1).alias("overlap_bases"), "same_strand",
    )
