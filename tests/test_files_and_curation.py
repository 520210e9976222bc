import hashlib

import pytest
from pyspark.sql import functions as F

from virocohort.functions import labels as lb
from virocohort.operators import curation as cu
from virocohort.operators import quality as qc
from virocohort.sources import scans, sinks
from virocohort.streaming import ingest


def test_fasta_folder_and_stream(spark, tmp_path):
    land = tmp_path / "land"
    (land / "sub").mkdir(parents=True)
    (land / "a.fasta").write_text(">g1 first phage\nACGT\nNNRA\n>g2\nacgtac\n")
    (land / "sub" / "b.fna").write_text(">g3 x\nTTTT\n>g4 empty\n\n")
    (land / "notes.txt").write_text(">no\nACGT\n")
    got = {(r.record_id, r.description, r.seq, r.reject_reason) for r in scans.read_fasta(spark, str(land), recursive=True).collect()}
    assert got == {("g1", "first phage", "ACGTNNRA", None), ("g2", "", "ACGTAC", None), ("g3", "x", "TTTT", None), ("g4", "empty", "", "EMPTY_SEQUENCE")}
    store, ck = str(tmp_path / "store"), str(tmp_path / "ck")
    ingest.ingest_stream(spark, str(land), store, ck).awaitTermination()
    (land / "c.fa").write_text(">g5\nGGGG\n")
    ingest.ingest_stream(spark, str(land), store, ck).awaitTermination()
    kept = spark.read.parquet(store + "/contigs")
    assert sorted(r.record_id for r in kept.collect()) == ["g1", "g2", "g3", "g5"]
    assert kept.where("record_id = 'g1'").first().seq == "ACGTNNNA"
    assert [r.record_id for r in spark.read.parquet(store + "/quarantine").collect()] == ["g4"]


def test_genbank_record(spark):
    text = ("LOCUS       AB1 60 bp\nVERSION     AB1.2\nFEATURES             Location/Qualifiers\n     source          1..60\n     CDS             complement(<3..>20)\n                     /locus_tag=\"t1\"\n"
            "                     /product=\"long\n                     name\"\n     CDS             join(1..5,9..12)\n                     /locus_tag=\"t2\"\nORIGIN\n        1 acgt\n")
    rows = scans.parse_genbank(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r.genome_id, r.s, r.e, r.strand, r.model_id, r.product) for r in rows] == [("AB1.2", 3, 20, "-", "t1", "long name")]


def test_table_write_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("G1", "p1", ["a", "b"]), ("G2", "p2", [])], "genome_id string, protein_id string, sources array<string>")
    sinks.write_table(df, ["protein_id", "sources"], str(tmp_path / "out"))
    back = spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "out"))
    assert {(r.genome_id, r.protein_id, r.sources) for r in back.collect()} == {("G1", "p1", "a;b"), ("G2", "p2", None)}
    before = sinks.manifest(spark, str(tmp_path / "out"))
    assert sinks.verify_manifest(before, before).count() == 0


def test_audit_chain_detects_tampering(spark):
    rows = [("u1" if i % 3 else "u2", i, f"v{i}") for i in range(40)]
    chain = cu.audit_chain(spark.createDataFrame(rows, "user_id string, event_id long, after string"), "user_id", ["event_id"])
    first = chain.where("user_id = 'u2'").orderBy("event_id").first()
    assert first.previous_sha256 == cu.GENESIS and first.sha256 == hashlib.sha256((cu.GENESIS + "|" + first.payload).encode()).hexdigest()
    assert cu.verify_chain(chain, "user_id", "event_id", ["event_id"], 10).count() == 0
    bad = chain.where("event_id <> 10").withColumn("payload", F.when(F.col("event_id") == 20, "{}").otherwise(F.col("payload")))
    got = {(r.event_id, r.problem) for r in cu.verify_chain(bad, "user_id", "event_id", ["event_id"], 10).collect()}
    assert got == {(11, "CHAIN_BROKEN"), (20, "CHECKSUM_MISMATCH")}


def test_gates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    qc.assert_allowed(df, "k", ["a", "b"])
    with pytest.raises(qc.GateError):
        qc.assert_unique(df, ["k", "v"])
    with pytest.raises(qc.GateError):
        qc.assert_allowed(df, "k", ["a"])


def test_label_rules(spark):
    cases = [("Major head protein", "major capsid protein"), ("hypothetical protein", None), ("DUF1234 family protein", None), ("sp|P1|ABC_BPT4 endolysin {ECO:0000255}", "endolysin"), ("gp12", None), ("RefSeq tail  spike", "tail spike protein"), (None, None)]
    df = spark.createDataFrame(cases, "d string, want string")
    for r in df.select("*", lb.normalise_function(F.col("d")).alias("got")).collect():
        assert r.got == r.want
    clean = [("probable tail protein gp25", "putative tail protein"), ("ORF12", "hypothetical protein"), ("Portal protein {ECO:1}", "Portal protein"), ("gene product", "hypothetical protein")]
    for r in spark.createDataFrame(clean, "d string, want string").select("*", lb.sanitise_product(F.col("d")).alias("got")).collect():
        assert r.got == r.want
