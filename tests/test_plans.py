"""Exploded or wide tables whose size a plan can't know must not be sent through the driver."""

import random
import re

from pyspark.sql import functions as F

from virocohort.operators import comparative as cg
from virocohort.operators import orf
from virocohort.operators import quality as qc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def contigs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"G{i}", "".join(rng.choice("ACGT") for _ in range(900))) for i in range(4)]
    spark.createDataFrame(rows, "genome_id string, seq string").write.parquet(str(tmp_path / "contigs"))
    return spark.read.parquet(str(tmp_path / "contigs"))


def test_sketches_meet_without_a_broadcast(spark, tmp_path):
    a = cg.sketch(contigs(spark, tmp_path), 16, 50)
    both = a.join(a.select("h", F.col("genome_id").alias("other")), "h")
    assert "BroadcastHashJoin" not in plan(both)
    assert both.where("genome_id = other").count() == 200


def test_sequences_and_starts_meet_models_without_a_broadcast(spark, tmp_path):
    c = contigs(spark, tmp_path)
    models = c.select("genome_id", F.lit("+").alias("strand"), F.lit(1).alias("s"), F.lit(30).alias("e"))
    assert "BroadcastHashJoin" not in plan(orf.with_cds(models, c))
    assert "BroadcastHashJoin" not in plan(models.crossJoin(c.select(F.lit(1).alias("x")).limit(1)).join(orf.stop_starts(c, 30).select("genome_id", "left"), "genome_id"))


def test_audit_and_rollup_send_no_contigs_through_the_driver(spark, tmp_path):
    c = contigs(spark, tmp_path)
    models = c.selectExpr("genome_id", "concat('M', genome_id) model_id", "7L s", "36L e", "'+' strand", "substr(seq, 7, 30) cds", "'M' protein")
    found = qc.audit_cds(models, c)
    assert "BroadcastExchange" not in plan(found)
    rolled = qc.genome_rollup(found, models, c)
    assert not re.search(r"BroadcastHashJoin \[genome_id#\d+\],", plan(rolled))  # pairs of models meet by bin, too
    assert [(r.sequence_length, r.predicted_cds, r.coding_bases) for r in rolled.collect()] == [(900, 1, 30)] * 4
