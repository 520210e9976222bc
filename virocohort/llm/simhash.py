"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints.  Text in ASCII lower case, words between ASCII blanks, shingles of k words; a bit is set where more than
half of the shingles' XXH64 hashes (seed 42) have it.

Search.  Equal fingerprints are one class.  The 64 bits are grouped into m parts, correlated bits together, with
thresholds that sum to ``distance - m + 1``: two fingerprints within the distance are within a part's threshold in one
part at least (a part with -1 is not probed).  Thresholds come from a dynamic programme over estimated candidate
counts: pairs that agree in a part are counted on all fingerprints, the growth with the threshold follows from the
bits' frequencies.  Of several m the cheapest plan is taken, so parts widen as the corpus grows.  One side is
probed with all values within the threshold, the first matching part alone gives a pair, and it is verified.

Crowded values.  Where more than ``crowd`` classes share a part's value, their pairs are not formed: each such class is
entered under itself and its neighbours at one bit (two classes within two bits meet under one of these, and
classes that meet there are within two bits), so every key has 65 members at most, linked to its least.
That covers a distance of up to two; larger distances verify all candidates, as the docstring of ``links`` says.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from virocohort.operators.components import connected_components
from virocohort.session import cut_lineage

BITS = 64


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The fingerprint of a text as a signed 64-bit integer; 0 without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, 42)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        hashes = [digest(line[a:b], 42) for a, b in zip([0, *ends], [e - 1 for e in ends[shingle - 1:]], strict=False)]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i:i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row: row, doc_id, fp (signed 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(fps, pa.int64())], names=["row", "doc_id", "fp"])

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Fingerprints, how often each bit is set, and how often each two are (64 x 64 sums from each task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.unpackbits(batch.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            both, n = both + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], names=["k", "v"])

    sums = dict(fps.select("fp").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect())
    both = np.array([sums.get(k, 0.0) for k in range(BITS * BITS)]).reshape(BITS, BITS)
    return int(sums.get(BITS * BITS, 0)), np.diag(both).copy(), both


def group_bits(n: int, ones: np.ndarray, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of about equal width: each starts at the bit that is left with the strongest ties, and takes the bits that
    correlate most with those it has."""
    p = ones / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(tie, 0)
    left, found = list(range(BITS)), []
    for k in range(parts, 0, -1):
        mine = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(mine[0])
        while len(mine) < (len(left) + len(mine)) // k:
            mine.append(max(left, key=lambda b: (tie[b, mine].sum(), -b)))  # noqa: B023
            left.remove(mine[-1])
        found.append(sorted(mine))
    return found


def _mask(bits) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << BITS) if x >> (BITS - 1) else x


def value_of(bits: list[int]):
    """The part's bits of fp, the others 0."""
    return F.col("fp").bitwiseAND(F.lit(_mask(bits)))


def _flips(bits: list[int], radius: int, value):
    """All values that differ from the given one in at most ``radius`` of the bits."""
    masks = F.array(*[F.lit(_mask(c)).cast("long") for r in range(radius + 1) for c in itertools.combinations(bits, r)])
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _entries(part: int, bits: list[int], radius: int):
    return F.transform(_flips(bits, radius, value_of(bits)), lambda v: F.struct(F.lit(part).alias("part"), v.alias("value")))


def _keyed(classes: DataFrame, entries: list) -> DataFrame:
    return classes.select("fp", "node", F.explode(F.concat(*entries)).alias("k")).select("fp", "node", "k.part", "k.value")


def estimated_pairs(same: int, part: list[int], rate: np.ndarray, radius: int) -> float:
    """Pairs within the radius in a part, from those that agree in it (0 counts as a half) and the bits' rates of difference."""
    odds = [rate[b] / max(1 - rate[b], 1e-9) for b in part]
    power = [1.0, *[0.0] * radius]
    for o in odds:
        for k in range(radius, 0, -1):
            power[k] += power[k - 1] * o
    return max(same, 0.5) * sum(power)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 and up) that sum to ``total`` at the least cost; costs[i][t + 1] is that of threshold t in part i."""
    best = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, taken) in best.items():
            for t in range(-1, len(cost) - 1):
                x = (c + cost[t + 1], [*taken, t])
                if s + t not in new or x < new[s + t]:
                    new[s + t] = x
        best = new
    return best[total]


def plan(fps: DataFrame, distance: int, most_parts: int = 4) -> list[tuple[list[int], int]]:
    """Parts and thresholds of the cheapest plan; its cost is candidates and probes together."""
    n, ones, both = bit_statistics(fps)
    p = ones / max(n, 1)
    rate = np.clip(2 * p * (1 - p), 1e-6, 0.5)
    options = {m: group_bits(n, ones, both, m) for m in range(2, min(most_parts, distance + 1) + 1)} if distance else {1: [list(range(BITS))]}
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(m * 64 + i).alias("part"), value_of(bits).alias("value")) for m, parts in options.items() for i, bits in enumerate(parts)])).alias("k")).select("k.*")
    same = dict(keyed.groupBy("part", "value").count().groupBy("part").agg(F.sum(F.expr("count * (count - 1) / 2"))).collect())
    best = None
    for m, parts in options.items():
        costs = [[0.0] + [estimated_pairs(same.get(m * 64 + i) or 0, bits, rate, t) + n * (1 + sum(math.comb(len(bits), k) for k in range(t + 1))) for t in range(distance + 1)]
                 for i, bits in enumerate(parts)]
        cost, taken = allocate(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = (cost, list(zip(parts, taken, strict=True)))
    return best[1]


def links(classes: DataFrame, distance: int = 2, crowd: int = 200) -> DataFrame:
    """Links (u, v) between classes (fp, node) that connect what pairs within the distance connect.

    Values of a part that at most ``crowd`` classes have give all their verified pairs.  Those of more classes are
    covered by the neighbours at one bit (distance 2 or less; for more, all their candidates are verified too).
    """
    parts = [(i, bits, t) for i, (bits, t) in enumerate(plan(classes, distance)) if t >= 0]
    index = _keyed(classes, [_entries(i, bits, 0) for i, bits, _ in parts])
    probes = _keyed(classes, [_entries(i, bits, t) for i, bits, t in parts])
    crowded = None
    if distance <= 2:
        crowded = cut_lineage(index.groupBy("part", "value").count().where(F.col("count") > crowd).select("part", "value"))
        dense = probes.join(crowded, ["part", "value"], "left_semi").select("fp", "node").distinct()
        index, probes = (x.join(crowded, ["part", "value"], "left_anti") for x in (index, probes))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (probes.withColumnsRenamed({"fp": "a", "node": "u"}).join(index.withColumnsRenamed({"fp": "b", "node": "v"}), ["part", "value"])
             .where("a < b").where(F.bit_count(differ) <= distance))
    if crowded is None:  # the first part that has a pair gives it; with crowds left out, any may be the one
        pairs = pairs.where(F.col("part") == F.coalesce(*[F.when(F.bit_count(differ.bitwiseAND(F.lit(_mask(bits)))) <= t, F.lit(i)) for i, bits, t in parts]))
    found = pairs.select("u", "v")
    if crowded is not None:
        # distinct fingerprints within one bit of a key: 65 at most
        meeting = dense.select("node", F.explode(_flips(list(range(BITS)), 1, F.col("fp"))).alias("key")).groupBy("key").agg(F.collect_list("node").alias("nodes")).where(F.size("nodes") > 1)
        found = found.unionByName(meeting.select(F.array_min("nodes").alias("u"), F.explode("nodes").alias("v")).where("u <> v"))
    return found.distinct()


def near_dedup(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text",
               row_col: str | None = None, crowd: int = 200) -> DataFrame:
    """One row per input row: row, doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)
    and component (a number of the group that is never null).

    Null, empty and blank texts have the fingerprint zero and are linked like any other.  Repeated rows and ids are
    kept.  A null id is in its component but never its name, unless all are null.  An empty table gives an empty
    result; other columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, shingle, id_col, text_col, row_col))
    # a class is named by its least row number, never null
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")))
    found = connected_components(classes.select("node", "fp", "least"), links(classes, distance, crowd))
    names = found.groupBy("component").agg(F.min("least").alias("component_id"))
    named = found.join(names, "component").select("fp", "component", "component_id")
    return prints.join(named, "fp").select("row", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")
