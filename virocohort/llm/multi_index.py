"""Nearest neighbours by an inverted multi-index.

Vectors are brought to length one; the first and the second half of their components are quantised apart, with
centroids fitted on a bounded sample.  A vector's cell is its pair of centroids.  A query walks the pairs in order of
summed squared distance, taking the next best from a heap, until the cells it has passed hold ``share`` of all vectors; it
goes to these cells, where cosines rank their entries.  Candidates are ranked in double precision on the original
vectors, so the scores are exact; only which entries are looked at is approximate.

Cells are dealt in blocks of about ``block_rows`` vectors, as many as a cell's count asks for, and queries in packs, so
neither a cell with most vectors nor one that most queries visit is held by one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from virocohort.session import cut_lineage

ENTRY = "cell long, block long, kind long, ids binary, data binary"
FOUND = "query_id long, vec_id long, score double"


def valid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and data (64-bit floats) of vectors that take part, once per id and vector.

    Null ids, null or zero vectors, and those with null or non-finite components are left out, as are vectors whose
    length isn't the most frequent one (of equally frequent lengths, the greatest).
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = common[0] if common else 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy().astype("<f8").reshape(-1, width) + 0.0  # no negative zeros
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in flat], pa.binary())], names=["id", "data"])

    return cut_lineage(fine.where(F.size("v") == width).mapInArrow(pack, "id long, data binary").distinct())


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one (scaled first, so that no square leaves the range)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from distinct sample rows; an empty centroid moves to the row that is farthest from its own."""
    rows = np.unique(sample, axis=0)
    k = min(k, len(rows))
    found = rows[np.random.default_rng(0).choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        d = distances(sample, found)
        own, far = d.argmin(1), d.min(1)
        for j in range(k):
            mine = own == j
            if mine.any():
                found[j] = sample[mine].mean(0)
            else:
                found[j] = sample[far.argmax()]
                far[far.argmax()] = 0
    return found


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells by rising sum of the two distances until they hold ``wanted`` vectors; empty cells are passed over."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    x, y, k = first[a].tolist(), second[b].tolist(), len(b)
    heap, have, found = [(x[0] + y[0], 0, 0)], 0, []
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * k + b[j]
        if counts[cell]:
            have += counts[cell]
            found.append(cell)
        if j + 1 < len(b):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return found


def matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def best_of(queries: np.ndarray, q_ids: np.ndarray, block: np.ndarray, ids: np.ndarray, top: int):
    """For each query its ``top`` ids of a block, each with its best vector: cosines by one product, those near the best
    again one by one."""
    rough = unit(queries) @ unit(block).T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0])
    each = rough if len(starts) == len(ids) else np.maximum.reduceat(rough[:, by_id], starts, axis=1)
    k = min(top, len(starts))
    least = np.partition(each, len(starts) - k, axis=1)[:, len(starts) - k] - 1e-9
    sizes = np.sqrt((block * block).sum(1))
    for i in range(len(queries)):
        at = np.flatnonzero((rough[i] >= least[i]) & (rough[i] > -np.inf))
        q = queries[i]
        score = (block[at] * q).sum(1) / (sizes[at] * np.sqrt((q * q).sum()))
        order = np.lexsort((ids[at], -score))
        if len(starts) < len(ids):
            order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])]
        order = order[:top]
        yield int(q_ids[i]), ids[at][order], score[order]


def search(vectors: DataFrame, is_query, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16,
           share: float = 0.65, sample_rows: int = 20_000, block_rows: int = 8192, pack_rows: int = 256) -> DataFrame:
    """Per query its nearest others by cosine: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    ``is_query`` is a condition on the column ``id``.  Vectors that don't take part are those that ``valid_vectors`` names; a
    repeated id with the same vector counts once, and rows with the query's id are never its neighbours.  Fewer candidates
    give fewer rows; an empty table an empty result.  ``sample_rows`` bounds the rows that centroids are fitted on (a hash
    of the id chooses them).  ``share`` is the part of all vectors a query looks at, or more where that could hold fewer
    than ``top`` other ids: at 0.65 at least nine in ten true
    neighbours were found on vectors without any structure, the hardest case.
    """
    rows = valid_vectors(vectors, id_col, vector_col)
    spark, (n, most) = rows.sparkSession, rows.groupBy("id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    few = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // sample_rows))) == 0).limit(2 * sample_rows).select("data").collect() or rows.limit(1).select("data").collect()
    sample = unit(np.frombuffer(b"".join(r[0] for r in few), "<f8").reshape(len(few), -1))
    half = (sample.shape[1] + 1) // 2
    wanted = max(int(np.ceil(share * n)), (top + 1) * most)  # so many vectors have ``top`` ids besides the query's own
    left = fit_centroids(sample[:, :half], k)
    right = fit_centroids(sample[:, half:], k) if sample.shape[1] > 1 else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column("data")))
            cell = distances(x[:, :half], left).argmin(1) * len(right) + distances(x[:, half:], right).argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), batch.column("id"), batch.column("data")], names=["cell", "id", "data"])

    index = cut_lineage(rows.mapInArrow(assign, "cell long, id long, data binary"))
    counts = np.zeros(len(left) * len(right), np.int64)
    for cell, count in index.groupBy("cell").count().collect():  # k * k rows at most
        counts[cell] = count
    blocks = np.maximum(1, -(-counts // block_rows))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            block = (ids * np.int64(2654435761) >> 16) % blocks[batch.column("cell").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("cell"), pa.array(block, pa.int64()), pa.array(np.zeros(len(ids), np.int64)),
                                              pa.array([x.tobytes() for x in ids.astype("<i8")], pa.binary()), batch.column("data")], names=[c.split()[0] for c in ENTRY.split(", ")])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, pack_rows):
                batch = whole.slice(start, pack_rows)
                ids, data = batch.column("id").to_numpy().astype("<i8"), matrix(batch.column("data"))
                x = unit(data)
                a, b, by_cell = distances(x[:, :half], left), distances(x[:, half:], right), {}
                for i in range(len(ids)):
                    for cell in walk(a[i], b[i], counts, wanted):
                        by_cell.setdefault(cell, []).append(i)
                for cell, at in by_cell.items():
                    m, packed = int(blocks[cell]), (ids[at].tobytes(), data[at].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([cell] * m, pa.int64()), pa.array(range(m), pa.int64()), pa.array([1] * m, pa.int64()),
                                                      pa.array([packed[0]] * m, pa.binary()), pa.array([packed[1]] * m, pa.binary())], names=[c.split()[0] for c in ENTRY.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, ids, data, held, best = None, [], [], None, {}

        def flush():
            out = [(q, v, s) for q, found in best.items() for s, v in ((-a, b) for a, b in found)]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for cell, block, kind, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, block) != where:
                    where, ids, data, held = (cell, block), [], [], None
                if kind == 0:
                    ids.append(i)
                    data.append(x)
                    continue
                if not ids:
                    continue
                if held is None:
                    held = np.frombuffer(b"".join(data), "<f8").reshape(len(ids), -1), np.frombuffer(b"".join(ids), "<i8")
                q_ids = np.frombuffer(i, "<i8")
                for q, v, s in best_of(np.frombuffer(x, "<f8").reshape(len(q_ids), -1), q_ids, *held, top):
                    nearest = {v: s for s, v in sorted([*best.get(q, ()), *zip((-s).tolist(), v.tolist(), strict=True)], reverse=True)}
                    best[q] = sorted((s, v) for v, s in nearest.items())[:top]
                if len(best) > 50_000:
                    yield flush()
        if any(best.values()):
            yield flush()

    both = index.mapInArrow(entries, ENTRY).unionByName(index.where(is_query).mapInArrow(visits, ENTRY))
    dealt = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return dealt.mapInArrow(scan, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
