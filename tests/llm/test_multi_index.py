"""The inverted multi-index against brute force."""

import math

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from virocohort.llm import multi_index


def brute(rows, queries, top):
    """rows: (id, vector); nearest by cosine in double precision, ties to the smaller id."""
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    found = {}
    for q in np.flatnonzero(queries(ids)):
        s = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
        at = np.flatnonzero(ids != ids[q])
        at = at[np.lexsort((ids[at], -s[at]))][:top]
        found[int(ids[q])] = [(int(ids[k]), float(s[k])) for k in at]
    return found


def answers(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_recall_on_the_table(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    t = pq.read_table(path)
    want = brute(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist())), lambda i: i % 50 == 0, 5)
    got = answers(multi_index.search(spark.read.parquet(path), F.col("id") % 50 == 0))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in want:
        exact = dict(want[q])
        assert all(math.isclose(s, exact[i], rel_tol=1e-12) for i, s in got[q] if i in exact)


def test_all_shares_give_the_exact_answer(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=7).tolist()) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(0), "data": F.lit("x"), "cell": F.lit(1)})
    want = brute(rows, lambda i: i % 50 == 0, 5)
    got = answers(multi_index.search(df, F.col("id") % 50 == 0, share=1.0, k=4, block_rows=32, pack_rows=3))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert got[1000] == [(i, 1.0) for i in range(1001, 1006)] or all(abs(s - 1) < 1e-15 for _, s in got[1000])


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [None, 1.0]), (250, [inf, 1.0]), (300, [1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(df, F.col("id") % 50 == 0, share=1.0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert multi_index.search(df.where("false"), F.col("id") % 50 == 0).collect() == []


def test_walk_is_by_summed_distance():
    r = np.random.default_rng(2)
    a, b, counts = r.random(9), r.random(7), r.integers(0, 3, 63)
    sums = (a[:, None] + b[None]).ravel()
    order = [c for c in np.argsort(sums) if counts[c]]
    assert multi_index.walk(a, b, counts, int(counts.sum())) == order
    part = multi_index.walk(a, b, counts, 10)
    assert part == order[:len(part)] and counts[part].sum() >= 10 > counts[part[:-1]].sum()


def test_copies_take_no_places(spark):
    """Rows of one id and vector, ids with several vectors, and a block's places, with the default share."""
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 5 + [(8, (x[0] + 0.01 * k).tolist()) for k in range(1, 7)]
    want = {}
    for i in (0, 50):
        best = {}
        for j, v in rows:
            if j != i:
                best[j] = max(best.get(j, -2), float(np.dot(x[i], v) / np.linalg.norm(x[i]) / np.linalg.norm(v)))
        want[i] = sorted(best, key=lambda j: (-best[j], j))[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(multi_index.search(df, F.col("id") % 50 == 0, k=1))
    assert {q: [i for i, _ in v] for q, v in got.items()} == want
    many = spark.createDataFrame([(0, x[7].tolist()), *[(7, x[7].tolist())] * 40, *[(10 + i, x[i].tolist()) for i in range(5)]], "vec_id long, embedding array<double>")
    assert len(answers(multi_index.search(many, F.col("id") == 0))[0]) == 5


def test_small_tables_give_all_candidates(spark):
    r = np.random.default_rng(6)
    for n in (3, 7):
        df = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(n)], "vec_id long, embedding array<double>")
        assert len(answers(multi_index.search(df, F.col("id") == 0))[0]) == min(5, n - 1)
