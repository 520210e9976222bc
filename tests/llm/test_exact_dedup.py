import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import same
from virocohort.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i, n))
    out = []
    for bare, members in groups.items():
        best = min(members, key=lambda m: m[:2] + (m[2] or 0,))
        twins = sum(m[:3] == best[:3] for m in members)
        for m in members:
            out.append((m[2], best[2], len(members), m[:3] == best[:3], twins, hashlib.sha256(bare.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("fan", "run_rows"), [(2, 4), (4, 8), (4, 16384)])
def test_equals_brute_force(odd_documents, odd_rows, fan, run_rows):
    got = exact_dedup(odd_documents, fan=fan, run_rows=run_rows).collect()
    want = brute(odd_rows)
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], [(w[0], w[1], w[2], w[5]) for w in want])
    kept = [r for r in got if r.kept]
    assert len(kept) == len({w[5] for w in want}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(no_documents):
    assert exact_dedup(no_documents).collect() == []


def test_digest_files_in_several_splits(spark, tmp_path):
    """One row per row also where a run's origin is read in many tasks."""
    rows = [(i, f"text {i % 50} " + "x" * (i % 3)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    docs.withColumn("no", F.monotonically_increasing_id()).write.option("parquet.block.size", "4096").parquet(f"{tmp_path}/rows")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "4096")
    try:
        read = spark.read.parquet(f"{tmp_path}/rows")
        want = [(w[0], w[1], w[2], w[3], w[5]) for w in brute(rows)]
        for row_col in (None, "no"):
            got = exact_dedup(read, row_col=row_col, run_rows=64).collect()
            same([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark._jsc.hadoopConfiguration().unset("parquet.block.size")
