"""SimHash near-dedup against brute force over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from virocohort.llm import simhash


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    """Union-find over all pairs of (key, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def expected(rows, k, distance):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    groups = brute_components(fps, distance)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, groups)), key=str)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice((5, 40, 300)))] for _ in range(40)]
    out = [" ".join(b) for b in base]
    for b in base:
        for _ in range(3):
            c = list(b)
            c[r.randrange(len(c))] = r.choice(vocabulary)
            out.append("  ".join(c).upper() + "\n")
    return out


def test_whole_method_equals_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "one two"), (905, "one two"), (905, "one two"), (None, "one"), (None, None), (None, "alone " * 9), (906, "é É ß " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "row": F.lit(1), "node": F.lit(None)})
    got = simhash.near_dedup(df, distance=2)
    assert got.columns == ["row", "doc_id", "fingerprint", "component_id", "component"]
    assert sorted((tuple(r)[1:4] for r in got.collect()), key=str) == expected(rows, 3, 2)


@pytest.mark.parametrize(("distance", "crowd"), [(0, 200), (1, 200), (2, 200), (2, 0), (2, 3), (3, 200), (5, 200)])
def test_links_connect_as_all_pairs_do(spark, distance, crowd):
    r = random.Random(distance * 10 + crowd)
    fps = {r.getrandbits(64) for _ in range(60)}
    for center in list(fps)[:12]:
        for _ in range(15):
            fps.add(center ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, node long")
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in simhash.links(classes, distance, crowd).collect():
        assert (fps[u] ^ fps[v]).bit_count() <= distance
        root[max(find(u), find(v))] = min(find(u), find(v))
    want = brute_components(fps, distance)
    got = [find(i) for i in range(len(fps))]
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def test_allocation_is_the_cheapest():
    import itertools

    costs = [[0, 5, 9, 40], [0, 2, 30, 31], [0, 7, 8, 9]]
    cost, taken = simhash.allocate(costs, 0)
    assert sum(taken) == 0
    assert cost == min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in itertools.product(range(-1, 3), repeat=3) if sum(ts) == 0)


def test_empty_table(spark):
    assert simhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
