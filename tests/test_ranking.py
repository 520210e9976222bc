"""Global ranks over ranges against a plain sort."""

from pyspark.sql import functions as F

from virocohort.operators.families import ranked
from virocohort.session import cut_lineage


def order():
    return [F.desc("genome_count"), F.desc("member_count"), F.asc("family_id")]


def test_ranks_where_all_families_have_two_genomes(spark):
    rows = spark.range(4000).selectExpr("concat('F', lpad((id * 7919) % 4000, 5, '0')) family_id", "2L genome_count", "if(id % 7 = 0, null, id % 5) member_count").repartition(7)
    got = [(r.family_id, r["rank"]) for r in ranked(rows, order()).orderBy("rank").collect()]
    want = sorted(((r.member_count is None, -(r.member_count or 0), r.family_id) for r in rows.collect()))
    assert got == [(f, i + 1) for i, (_, _, f) in enumerate(want)]


def test_ranges_are_even(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4000).selectExpr("2L genome_count", "id member_count", "cast(id as string) family_id").repartition(7)
        placed = cut_lineage(rows.orderBy(*order()).withColumn("p", F.spark_partition_id()))
        sizes = [r["count"] for r in placed.groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / len(sizes)


def test_no_rows(spark):
    assert ranked(spark.createDataFrame([], "family_id string, genome_count long, member_count long"), order()).collect() == []
