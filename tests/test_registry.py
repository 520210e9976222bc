"""The contract of the entry module, and a sample of queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows_of
from virocohort.plans.tables import BASE

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("sq11_rbs_score", "or02_stop_starts", "iv01_overlap_join", "iv12_coding_density", "ev16_top_hits", "fu06_product_selection", "wn05_local_ambiguity", "fm17_conserved_neighbourhoods",
          "cg01_nearest_references", "mt09_concordance_summary", "qc03_presubmission", "cu01_apply_edits", "sc04_gff_scan")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "functional_state" in out.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in BASE:
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, rel.fetchall())
