"""Interval operators against brute force, including one genome that holds most rows."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from virocohort.operators import intervals as iv
from virocohort.operators import screens as sc
from virocohort.operators.components import connected_components
from virocohort.operators.ordering import ordinal, with_neighbours


def models(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randint(1, 9000)
        out.append(("HOT" if rng.random() < 0.6 else f"G{rng.randint(1, 5)}", f"m{i:04d}", s, s + rng.randint(0, 700), rng.choice("+-")))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "genome_id string, model_id string, s long, e long, strand string").repartition(7)


def test_overlap_join_equals_brute_force(spark):
    rows = models()
    want = {(a[1], b[1], min(a[3], b[3]) - max(a[2], b[2]) + 1) for a in rows for b in rows
            if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and a[3] >= b[2]}
    for size in (1, 97, 1000, 100_000):
        if size == 1:
            continue
        got = iv.self_overlap(frame(spark, rows), ["genome_id"], "model_id", size=size)
        seen = [(r.model_id_a, r.model_id_b, r.overlap) for r in got.collect()]
        assert len(seen) == len(set(seen)) and set(seen) == want


def test_overlap_join_with_slack(spark):
    rows = models(150)
    a = frame(spark, rows).select("genome_id", F.col("model_id").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = frame(spark, rows).select("genome_id", F.col("model_id").alias("b"), "s", "e")
    got = {(r.a, r.b) for r in iv.overlap_join(a, b, ["genome_id"], ("s1", "e1"), ("s", "e"), 100, slack=16).collect()}
    assert got == {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and y[2] <= x[3] + 16 and y[3] >= x[2] - 16}


def test_covered_and_uncovered(spark):
    rows = models(300)
    want = {}
    for g, _, s, e, _ in rows:
        want.setdefault(g, set()).update(range(s, e + 1))
    got = {r.genome_id: r.covered for r in iv.covered_length(frame(spark, rows), ["genome_id"], size=128).collect()}
    assert got == {g: len(v) for g, v in want.items()}
    cand, occ = rows[:40], rows[40:]
    free = iv.uncovered_length(frame(spark, cand).select("genome_id", "model_id", "s", "e"), frame(spark, occ).select("genome_id", F.col("s").alias("a"), F.col("e").alias("b")),
                               ["genome_id"], "model_id", ("s", "e"), ("a", "b"))
    for r in free.collect():
        taken = {p for g, _, s, e, _ in occ if g == r.genome_id for p in range(s, e + 1)}
        assert r.uncovered == sum(p not in taken for p in range(r.s, r.e + 1))


def test_nearest_start(spark):
    rows = models(120)
    pts, calls = rows[:60], rows[60:]
    got = sc.nearest_start(frame(spark, pts).withColumnRenamed("model_id", "pid"), frame(spark, calls), ["genome_id"], "pid", 250)
    have = {r.pid: (r.start_distance, r.nearest_call) for r in got.collect()}
    for g, pid, s, *_ in pts:
        near = [(abs(c[2] - s), c[2], c[1]) for c in calls if c[0] == g]
        if near:
            d, _, cid = min(near)
            assert have[pid] == (d, cid)
        else:
            assert pid not in have


def test_components_match_union_find_whatever_the_partitioning(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randint(0, 300):03d}", f"n{rng.randint(0, 300):03d}") for _ in range(200)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    nodes = sorted({x for e in edges for x in e} | {"lonely"})
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    for parts in (1, 5):
        got = connected_components(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "u string, v string").repartition(parts))
        assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in nodes}


def test_order_and_neighbours_across_blocks(spark):
    rows = models(500)
    df = ordinal(frame(spark, rows), ["genome_id"], "s", ["s", "e", "model_id"], size=300)
    df = with_neighbours(df, ["genome_id"], "idx", 2, lambda f: {"near": F.concat(F.collect_list("model_id").over(f(-2, -1)), F.collect_list("model_id").over(f(1, 2)))}, block=5)
    got = {r.model_id: (r.idx, list(r.near)) for r in df.collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        line = [r[1] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[3], r[1]))]
        for i, m in enumerate(line):
            assert got[m] == (i, line[max(0, i - 2):i] + line[i + 1:i + 3])


def test_spanin_pairs(spark):
    rows = [("G", "a", 1, 300, "+", "Rz-like spanin", False), ("G", "b", 290, 480, "+", "spanin", True), ("G", "c", 2000, 2300, "-", "spanin", False), ("G", "d", 1800, 1999, "-", "Rz1-like spanin", True),
            ("G", "e", 5000, 5200, "+", "spanin", False), ("G", "f", 5205, 5300, "+", "spanin", True), ("G", "g", 5210, 5350, "+", "spanin", True)]
    g = spark.createDataFrame(rows, "genome_id string, model_id string, s long, e long, strand string, name string, outer_support boolean")
    # a/b overlap in relative frame 1; c/d abut on the minus strand; e has two partners and stays open
    assert {(r.inner_id, r.outer_id) for r in sc.spanin_pairs(g).collect()} == {("a", "b"), ("c", "d")}


def brute_bases(rows):
    best = {}
    for g, qs, qe, length, nident, score in rows:
        if length > 0:
            for x in range(qs, qe + 1):
                best[g, x] = max(best.get((g, x), ()), (score, qs, qe, length, nident))
    out = {}
    for (g, _), (_, _, _, length, nident) in best.items():
        a, n = out.get(g, (0.0, 0))
        out[g] = (a + nident / length, n + 1)
    return out


def test_best_alignment_per_base_equals_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(400):
        qs = rng.randint(0, 45_000)
        size = rng.choice((1, 2, 3, 50, 64, 700, 3000))
        rows.append((rng.choice("HHHab"), qs, qs + size - 1, rng.choice((0, size, size)), rng.randint(0, size), rng.choice((10.0, 20.0, 20.0, 30.0))))
    df = spark.createDataFrame(rows, "g string, qs long, qe long, aln_len long, nident long, score double").repartition(4)
    got = {r.g: (r.identical, r.aligned_bases) for r in iv.best_hsp_per_base(df, ["g"]).collect()}
    want = brute_bases(rows)
    assert got.keys() == want.keys()
    assert all(got[g][1] == want[g][1] and abs(got[g][0] - want[g][0]) < 1e-6 for g in want)


def test_one_long_alignment_makes_few_rows(spark):
    """5,000,000 bases: tiles and segments, not a row a base."""
    df = spark.createDataFrame([("a", 1, 5_000_000, 5_000_000, 4_000_000, 9.0), ("a", 1000, 1999, 1000, 1000, 10.0)], "g string, qs long, qe long, aln_len long, nident long, score double")
    assert df.select(F.explode(iv.dyadic_blocks(F.col("qs"), F.col("qe")))).count() < 100
    r = iv.best_hsp_per_base(df, ["g"]).first()
    assert r.aligned_bases == 5_000_000 and abs(r.identical - (4_999_000 * 0.8 + 1000)) < 1e-6


def test_identity_does_not_depend_on_row_order(spark):
    """Thirds and sevenths of many alignments: the sum is the nearest double of the true one, however the rows are dealt."""
    rows = [("a", 3 * i, 3 * i + 2, 3 + 4 * (i % 2), 1 + i % 2, float(i % 5)) for i in range(1, 4001)]
    want = float(sum(Fraction(3 * r[4], r[3]) for r in rows))
    for n in (1, 7):
        df = spark.createDataFrame(rows, "g string, qs long, qe long, aln_len long, nident long, score double").repartition(n)
        assert iv.best_hsp_per_base(df, ["g"]).first().identical == want


def test_best_alignment_per_base_moves_few_rows(spark):
    """Two exchanges of the alignments and one of the sums: no row a tile, segment or level."""
    df = spark.createDataFrame([("a", 1, 50, 50, 40, 9.0)], "g string, qs long, qe long, aln_len long, nident long, score double")
    assert iv.best_hsp_per_base(df, ["g"])._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 3


def test_missing_scores_are_the_worst(spark):
    rows = [("a", 1, 10, 10, 5, None), ("a", 3, 4, 2, 2, 1.0), ("a", 8, 12, 5, None, 2.0), ("a", 20, 21, 0, 0, 9.0)]
    r = iv.best_hsp_per_base(spark.createDataFrame(rows, "g string, qs long, qe long, aln_len long, nident long, score double"), ["g"]).first()
    assert (r.identical, r.aligned_bases) == (4.5, 12)
