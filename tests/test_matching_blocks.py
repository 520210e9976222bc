"""Sequential matching over blocks against the plain walk, on random and on chained edges."""

import random

import pytest

from virocohort.operators import matching as m

EDGES = "genome_id string, p string, d string, turn struct<t: long, p: string>, pref long, fits boolean, overlap long, rank long, place long"


def local_edges(n, seed, reach=3):
    """Items on two axes, linked to partners close by; a third of them in few crowded places."""
    rng = random.Random(seed)
    out = []
    for g in ("HOT", "A"):
        for i in range(n if g == "HOT" else n // 5):
            at = rng.choice([i, i, 7])
            for j in {max(0, at + rng.randint(-reach, reach)) for _ in range(rng.randint(1, 4))}:
                p = f"p{i:05d}"
                out.append((g, p, f"d{j:05d}", (at, p), rng.randint(0, 10 ** 9), rng.random() < 0.8, rng.randint(1, 90), 0, at))
    ranks = list(range(len(out)))
    rng.shuffle(ranks)
    return [(*row[:7], rank, row[8]) for row, rank in zip(out, ranks, strict=True)]


def chain(n):
    """Each item wants what the one before it may take: every choice hangs on the first."""
    out = []
    for i in range(n):
        for j, pref in ((i, 2), (i + 1, 1)):
            out.append(("G", f"p{i:06d}", f"d{j:06d}", (i, f"p{i:06d}"), pref, True, 5, 4 * n - 2 * i - (j > i), i))
    return [*out, ("G", "a", "d000000", (-1, "a"), 1, True, 5, 4 * n + 1, -1)]


def by_turn(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[3], r[1]), []).append(r)
    return [groups[k] for k in sorted(groups)]


def walk_ordered(rows):
    used, out = set(), set()
    for own in by_turn(rows):
        free = [r for r in own if (r[0], r[2]) not in used]
        if free:
            best = max(free, key=lambda r: r[4])
            if best[5]:
                used.add((best[0], best[2]))
                out.add((best[0], best[1], best[2], best[6]))
    return out


def walk_single(rows):
    used, out = set(), set()
    for own in by_turn(rows):
        free = [r for r in own if (r[0], r[2]) not in used]
        if len(free) == 1:
            used.add((free[0][0], free[0][2]))
        if free:
            out.add((free[0][0], free[0][1], len(free), free[0][2] if len(free) == 1 else None))
    return out


def walk_best(rows):
    left, right, out = set(), set(), set()
    for r in sorted(rows, key=lambda r: -r[7]):
        if (r[0], r[1]) not in left and (r[0], r[2]) not in right:
            left.add((r[0], r[1]))
            right.add((r[0], r[2]))
            out.add((r[0], r[1], r[2]))
    return out


RULES = [(m.ordered_choice, walk_ordered), (m.single_choice, walk_single), (m.mutual_best, walk_best)]


@pytest.mark.parametrize(("rule", "walk"), RULES)
@pytest.mark.parametrize(("seed", "block_rows"), [(1, 40), (2, 150), (3, 10_000)])
def test_blocks_give_the_walks_outcome(spark, rule, walk, seed, block_rows):
    rows = local_edges(250, seed)
    got = [tuple(r) for r in rule(spark.createDataFrame(rows, EDGES).repartition(3), block_rows=block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == walk(rows)


@pytest.mark.parametrize(("rule", "walk"), RULES)
def test_a_chain_of_10000_takes_a_round_a_block(spark, rule, walk, monkeypatch):
    rows = chain(10_000)
    rounds, count = [], m.cut_lineage
    monkeypatch.setattr(m, "cut_lineage", lambda df: rounds.append(1) or count(df))
    got = {tuple(r) for r in rule(spark.createDataFrame(rows, EDGES), block_rows=5_000).collect()}
    assert got == walk(rows)
    assert len(rounds) <= 1 + 3 * 6  # three tables a round


@pytest.mark.parametrize(("rule", "walk"), RULES)
def test_no_edges(spark, rule, walk):
    assert rule(spark.createDataFrame([], EDGES)).collect() == []
