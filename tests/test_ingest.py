import random

from virocohort.sources import scans
from virocohort.streaming import ingest


def states(spark, store):
    rows = ingest.sample_registry(spark, store).collect()
    return sorted((r.batch, r.name, r.state, r.sample_id, r.reused_from) for r in rows)


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_stream_keeps_samples_over_batches(spark, tmp_path):
    land, store, ck = tmp_path / "land", str(tmp_path / "store"), str(tmp_path / "ck")
    put(land, "x/a.fasta", ">g1\nACGTACGT\n>g2\nTTTT\n")
    put(land, "y/a.fasta", ">g1\nCCCC\n")
    put(land, "b.fa", ">h\n\n")
    ingest.ingest_stream(spark, str(land), store, ck).awaitTermination()
    assert states(spark, store) == [(0, "a", "SUCCESS", "a", None), (0, "a", "SUCCESS", "a_2", None), (0, "b", "FAILED", "b", None)]
    put(land, "c d.fa", ">g2\nTTTT\n>g1\nACGTACGT\n")  # the records of x/a.fasta in another order
    put(land, "z/a.fasta", ">g9\nGGGG\n")
    put(land, "a_3.fa", ">g8\nGGCC\n")
    put(land, "bad/b.fa", ">h\n\n")
    ingest.ingest_stream(spark, str(land), store, ck).awaitTermination()
    old = next(r.sample_id for r in ingest.sample_registry(spark, store).where("file_path like '%/x/a.fasta'").collect())
    assert states(spark, store)[3:] == [(1, "a", "SUCCESS", "a_4", None), (1, "a_3", "SUCCESS", "a_3", None), (1, "b", "FAILED", "b_2", None),
                                        (1, "c_d", "REUSED", "c_d", old)]
    kept = spark.read.parquet(store + "/contigs")
    assert kept.where("sample_id = 'c_d'").isEmpty() and kept.count() == 5
    assert spark.read.parquet(store + "/quarantine").count() == 2

    # a batch that runs again after a failure finds what it found before
    before = states(spark, store)
    again = scans.read_fasta(spark, str(land), recursive=True).where("file_path not like '%/x/%' and file_path not like '%/y/%' and file_path not like '%/land/b.fa'")
    ingest.land_batch(again, 1, store)
    assert states(spark, store) == before and spark.read.parquet(store + "/contigs").count() == 5


def test_names_stay_unique(spark):
    """Ids of several batches against a walk that numbers each name's samples with what is free."""
    rng, registry, used, count = random.Random(5), [], set(), {}
    for batch in range(4):
        landed = sorted({(rng.choice(["a", "a", "a_2", "a_4", "a_2_2", "b"]), f"{rng.getrandbits(64):016x}", True) for _ in range(7)})
        got = ingest.place_samples(spark.createDataFrame(landed, "name string, sha string, usable boolean"),
                                   spark.createDataFrame(registry, "sample_id string, name string, sha string")).collect()
        assert len(got) == len(landed)
        names = {n for n, _, _ in landed}
        for r in sorted(got, key=lambda r: (r.name, r.sha)):
            assert r.sample_id not in used and r.state == "SUCCESS"
            assert r.sample_id == r.name or r.sample_id.startswith(r.name + "_")
            assert r.sample_id == r.name or r.sample_id not in names
            used.add(r.sample_id)
            registry.append((r.sample_id, r.name, r.sha))
    assert "a" in used and "a_3" in used


def test_no_samples(spark):
    none = ingest.place_samples(spark.createDataFrame([], "name string, sha string, usable boolean"), spark.createDataFrame([], "sample_id string, name string, sha string"))
    assert none.isEmpty()
