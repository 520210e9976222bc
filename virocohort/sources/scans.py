"""Scans of tool and database text (SC01-SC20).

A scan is a function from a DataFrame with a ``value`` column (lines, or records cut with the text
reader's ``lineSep``) to typed columns, all native expressions.  Rows that break a rule are kept in a
``reject_reason`` column rather than dropped or raised, so one bad line never fails a cohort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from virocohort.operators.ordering import ordinal

FASTA_FILES = "*.{fa,fna,fasta}"


def read_fasta(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """SC01/SC03: FASTA files, or a directory of them, one row per record."""
    reader = spark.read.option("lineSep", "\n>")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", FASTA_FILES)
    return parse_fasta(reader.text(path).select("value", F.col("_metadata.file_path").alias("file_path")))


def parse_fasta(records: DataFrame) -> DataFrame:
    """SC01/SC02: id, description and sequence of records split at ``\\n>``."""
    text = F.regexp_replace("value", "^>", "")
    head = F.substring_index(text, "\n", 1)
    body = F.substring(text, F.length(head) + 2, F.length(text))
    rows = records.select(
        *[c for c in records.columns if c != "value"], F.regexp_extract(head, r"^(\S+)", 1).alias("record_id"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"),
        F.upper(F.regexp_replace(body, r"\s+", "")).alias("seq"))
    return rows.withColumn("reject_reason", F.when(F.col("record_id") == "", "MISSING_IDENTIFIER").when(F.col("seq") == "", "EMPTY_SEQUENCE"))


def parse_gff(lines: DataFrame, feature: str = "CDS") -> DataFrame:
    """SC04: GFF3 features of one type; comment and FASTA lines have fewer than nine columns."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 9) & (f[2] == feature))
    attrs = F.str_to_map(f[8], F.lit(";"), F.lit("="))
    get = lambda k: F.url_decode(F.element_at(attrs, k))
    s, e = f[3].try_cast("bigint"), f[4].try_cast("bigint")
    return rows.select(
        f[0].alias("genome_id"), s.alias("s"), e.alias("e"), f[6].alias("strand"), F.coalesce(get("ID"), get("locus_tag"), F.concat_ws("_", f[0], f[3], f[4], f[6])).alias("model_id"), get("product").alias("product"),
        F.when(get("translation").isNotNull(), F.sha2(get("translation"), 256)).alias("protein_sha256"), F.when(s.isNull() | e.isNull() | (s < 1) | (e < s), "BAD_COORDINATES").alias("reject_reason"))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    return parse_genbank(spark.read.option("lineSep", "\n//").text(path))


def parse_genbank(records: DataFrame) -> DataFrame:
    """SC05: coding sequences of GenBank records; joined locations are skipped."""
    text = F.col("value")
    name = F.coalesce(*[F.nullif(F.regexp_extract(text, r"(?m)^" + k + r"\s+(\S+)", 1), F.lit("")) for k in ("VERSION", "ACCESSION", "LOCUS")])
    table = F.substring_index(F.substring_index(text, "\nORIGIN", 1), "\nFEATURES", -1)
    features = F.filter(F.split(table, r"\n {5}(?=\S)"), lambda x: x.startswith("CDS "))
    rows = records.select(name.alias("genome_id"), F.explode(features).alias("f")).withColumn("f", F.regexp_replace("f", r"\n {21}", " "))
    where = F.regexp_replace(F.regexp_replace(F.regexp_extract("f", r"^CDS\s+(\S+)", 1), "[<>]", ""), r"\s", "")
    rows = rows.withColumn("where", where).where(F.col("where").rlike(r"^(complement\()?\d+\.\.\d+\)?$"))
    q = lambda k: F.nullif(F.regexp_extract("f", f'/{k}="([^"]*)"', 1), F.lit(""))
    return rows.select(
        "genome_id", F.regexp_extract("where", r"(\d+)\.\.", 1).cast("bigint").alias("s"), F.regexp_extract("where", r"\.\.(\d+)", 1).cast("bigint").alias("e"),
        F.when(F.col("where").startswith("complement"), "-").otherwise("+").alias("strand"), F.coalesce(q("locus_tag"), q("protein_id")).alias("model_id"), q("product").alias("product"), F.replace(q("translation"), F.lit(" "), F.lit("")).alias("translation"))


def parse_domains(lines: DataFrame) -> DataFrame:
    """SC06: profile-search domain table: independent E-value and coverages; malformed lines drop out."""
    f = F.split(F.trim("value"), r"\s+", 23)
    num = lambda i, t="double": f[i].try_cast(t)
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 22)).select(
        f[0].alias("target"), f[1].alias("accession"), f[3].alias("protein_id"), num(6).alias("full_evalue"), num(12).alias("evalue"), num(13).alias("score"),
        ((num(18, "bigint") - num(17, "bigint") + 1) / num(5, "bigint")).alias("query_coverage"), ((num(16, "bigint") - num(15, "bigint") + 1) / num(2, "bigint")).alias("profile_coverage"))
    return rows.where("full_evalue is not null and evalue is not null and query_coverage is not null")


def parse_table(lines: DataFrame, columns: Sequence[tuple[str, str]], rules: dict[str, Column] | None = None) -> DataFrame:
    """Tab-separated rows with typed columns; wrong width, unreadable numbers and broken rules are rejects."""
    f = F.split("value", "\t", -1)
    rows = lines.where(F.trim("value") != "").select("value", (F.size(f) != len(columns)).alias("__w"), *[
        (F.get(f, F.lit(i)).try_cast(t) if t != "string" else F.get(f, F.lit(i))).alias(n) for i, (n, t) in enumerate(columns)])
    reason = F.when(F.col("__w"), "WRONG_COLUMN_COUNT")
    for n, t in columns:
        if t != "string":
            reason = reason.when(F.col(n).isNull(), f"INVALID_{n.upper()}")
    for name, bad in (rules or {}).items():
        reason = reason.when(bad, name)
    return rows.withColumn("reject_reason", reason).drop("__w", "value")


PROFILE_COLUMNS = [("protein_id", "string"), ("identifier", "string"), ("identity", "double"), ("aln_len", "bigint"), ("qs", "bigint"), ("qe", "bigint"), ("qlen", "bigint"), ("ts", "bigint"), ("te", "bigint"),
                   ("tlen", "bigint"), ("evalue", "double"), ("bits", "double"), ("query_coverage", "double"), ("target_coverage", "double")]
PROTEIN_COLUMNS = [("protein_id", "string"), ("subject", "string"), ("pident", "double"), ("aln_len", "bigint"), ("qlen", "bigint"), ("slen", "bigint"), ("qs", "bigint"), ("qe", "bigint"), ("ss", "bigint"), ("se", "bigint"),
                   ("evalue", "double"), ("bits", "double")]
FAMILY_COLUMNS = [("protein_id", "string"), ("family_id", "string"), ("identity", "double"), ("aln_len", "bigint"), ("qlen", "bigint"), ("tlen", "bigint"), ("evalue", "double"), ("bits", "double"), ("query_coverage", "double"),
                  ("target_coverage", "double")]
STRUCTURE_COLUMNS = [("query", "string"), ("target", "string"), ("fident", "double"), ("alnlen", "bigint"), ("qlen", "bigint"), ("tlen", "bigint"), ("qcov", "double"), ("tcov", "double"), ("evalue", "double"), ("bits", "double"),
                     ("qtmscore", "double"), ("ttmscore", "double")]


def parse_profile_hits(lines: DataFrame) -> DataFrame:
    """SC07: 14-column profile search."""
    return parse_table(lines, PROFILE_COLUMNS)


def parse_protein_hits(lines: DataFrame) -> DataFrame:
    """SC08: 12-column protein alignments with clamped coverages and the accession of the subject."""
    clip = lambda a, b, n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(F.col(b) - F.col(a)) + 1) / F.col(n)))
    t = parse_table(lines, PROTEIN_COLUMNS)
    tagged = F.col("subject").startswith("sp|") | F.col("subject").startswith("tr|")
    return t.select("*", clip("qs", "qe", "qlen").alias("query_coverage"), clip("ss", "se", "slen").alias("subject_coverage"),
                    F.when(tagged, F.split_part("subject", F.lit("|"), F.lit(2))).otherwise(F.col("subject")).alias("accession"))


def parse_family_hits(lines: DataFrame) -> DataFrame:
    """SC09: 10-column family search; identities written as percentages become fractions."""
    return parse_table(lines, FAMILY_COLUMNS).withColumn("identity", F.when(F.col("identity") > 1, F.col("identity") / 100).otherwise(F.col("identity")))


def parse_hsps(lines: DataFrame) -> DataFrame:
    """SC10: 5-column nucleotide alignments with ordered query ends."""
    t = parse_table(lines, [("qstart", "bigint"), ("qend", "bigint"), ("aln_len", "bigint"), ("nident", "bigint"), ("score", "double")])
    return t.select(F.least("qstart", "qend").alias("qs"), F.greatest("qstart", "qend").alias("qe"), "aln_len", "nident", "score", "reject_reason")


def parse_gapped_hsps(lines: DataFrame, query_length: Column, reference_length: Column) -> DataFrame:
    """SC10: 7-column alignments with gapped sequences whose lengths must agree with their coordinates."""
    cols = [("qs", "bigint"), ("qe", "bigint"), ("ss", "bigint"), ("se", "bigint"), ("score", "double"), ("qseq", "string"), ("sseq", "string")]
    bases = lambda c: F.length(F.replace(F.col(c), F.lit("-"), F.lit("")))
    rules = {
        "SEQUENCE_LENGTHS_DIFFER": F.length("qseq") != F.length("sseq"),
        "COORDINATES_OUT_OF_RANGE": ~(F.col("qs").between(1, query_length) & F.col("qe").between(1, query_length) & F.col("ss").between(1, reference_length) & F.col("se").between(1, reference_length)),
        "SEQUENCE_COORDINATE_MISMATCH": (bases("qseq") != F.abs(F.col("qe") - F.col("qs")) + 1) | (bases("sseq") != F.abs(F.col("se") - F.col("ss")) + 1)}
    return parse_table(lines, cols, rules)


def parse_sketch_distances(lines: DataFrame) -> DataFrame:
    """SC11: reference, query, distance, p-value and shared hashes ``k/n``."""
    t = parse_table(lines, [("ref", "string"), ("sample_id", "string"), ("distance", "double"), ("p_value", "double"), ("shared", "string")])
    return t.select(F.split_part("ref", F.lit(" "), F.lit(1)).alias("reference"), "sample_id", "distance", "p_value", "shared",
                    F.split_part("shared", F.lit("/"), F.lit(1)).try_cast("bigint").alias("shared_hashes"), F.split_part("shared", F.lit("/"), F.lit(2)).try_cast("bigint").alias("sketch_size"), "reject_reason")


def parse_structure_hits(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """SC12: 12-column structure matches with their group (target, group), ``unknown`` by default."""
    outside = F.lit(False)
    for c in ("fident", "qcov", "tcov", "qtmscore", "ttmscore"):
        outside = outside | ~F.col(c).between(0, 1)
    rules = {"EMPTY_IDENTIFIER": (F.col("query") == "") | (F.col("target") == ""), "FRACTION_OUTSIDE_0_1": outside, "LENGTH_NOT_POSITIVE": (F.col("alnlen") <= 0) | (F.col("qlen") <= 0) | (F.col("tlen") <= 0),
             "NEGATIVE_SCORE": (F.col("evalue") < 0) | (F.col("bits") < 0), "IMPLAUSIBLE_ALIGNMENT_LENGTH": F.col("alnlen") > 2 * F.greatest("qlen", "tlen")}
    clean = groups.groupBy("target").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
    t = parse_table(lines, STRUCTURE_COLUMNS, rules).join(clean, "target", "left")
    return t.withColumn("target_group", F.coalesce("lo", F.lit("unknown"))).withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.col("lo") != F.col("hi"), "CONFLICTING_TARGET_GROUP"))).drop("lo", "hi")


def gene_calls(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """SC13: caller coordinates (genome_id, raw_start, raw_end, raw_strand) as ordered, numbered models."""
    minus = (F.col("raw_start") > F.col("raw_end")) | (F.coalesce("raw_strand", F.lit("+")) == "-")
    m = rows.join(lengths, "genome_id", "left").select(
        "genome_id", F.least("raw_start", "raw_end").cast("bigint").alias("s"), F.greatest("raw_start", "raw_end").cast("bigint").alias("e"), F.when(minus, "-").otherwise("+").alias("strand"), "genome_length")
    bad = F.when(F.col("genome_length").isNull(), "UNKNOWN_GENOME").when((F.col("s") < 1) | (F.col("e") > F.col("genome_length")), "OUT_OF_RANGE")
    m = m.withColumn("reject_reason", bad)
    numbered = ordinal(m.where("reject_reason is null"), ["genome_id"], "s", ["s", "e", "strand"]).withColumn("model_id", F.format_string("PM_%06d", F.col("idx") + 1)).drop("idx")
    return numbered.unionByName(m.where("reject_reason is not null"), allowMissingColumns=True).drop("genome_length")


def parse_trna(lines: DataFrame) -> DataFrame:
    """SC14: tRNA table; introns, undetermined and pseudo calls go to specialist review."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.size(f) >= 9) & f[1].rlike(r"^\d+$"))
    a, b = f[2].cast("bigint"), f[3].cast("bigint")
    notes = F.array_join(F.slice(f, 10, 100), " ")
    unsure = (f[6].cast("int") != 0) | (f[7].cast("int") != 0) | F.lower(f[4]).isin("undet", "unknown", "pseudo") | F.lower(notes).contains("pseudo")
    return rows.select(f[0].alias("seqid"), F.lit("tRNA").alias("type"), F.least(a, b).alias("s"), F.greatest(a, b).alias("e"), F.when(a <= b, "+").otherwise("-").alias("strand"), F.concat(F.lit("tRNA-"), f[4]).alias("product"),
                       f[5].alias("anticodon"), f[8].cast("double").alias("score"), F.when(unsure, "INTRON_OR_UNCERTAIN_TRNA").alias("reject_reason"))


def family_key(identifier: Column) -> Column:
    """SC15: numeric key behind spellings such as ``12``, ``phrog_12`` and ``PHROG12``."""
    return F.regexp_extract(identifier, r"(\d+)$", 1).try_cast("bigint")


def annotate_families(hits: DataFrame, annotations: DataFrame) -> DataFrame:
    """SC15: join family annotations on the numeric key (annotations: identifier, category, description)."""
    a = annotations.groupBy(family_key(F.col("identifier")).alias("k")).agg(F.min("category").alias("family_category"), F.min("description").alias("family_description"))
    return hits.withColumn("k", family_key(F.col("identifier"))).join(a, "k", "left").drop("k")


def parse_curated(records: DataFrame) -> DataFrame:
    """SC16: curated protein records: reviewed flag, name, organism, taxon, gene and existence level."""
    x = lambda p: F.nullif(F.trim(F.regexp_extract("value", p, 1)), F.lit(""))
    return records.where(F.col("value").contains("ID   ")).select(
        x(r"(?m)^AC   ([^;]+);").alias("accession"), x(r"(?m)^ID   (\S+)").alias("entry_name"), F.col("value").rlike(r"(?m)^ID   .*Reviewed;").alias("reviewed"), x(r"RecName: Full=([^;{]+)").alias("name"),
        x(r"(?m)^OS   (.+?)\.?$").alias("organism"), x(r"(?m)^OX   NCBI_TaxID=(\d+)").alias("taxon_id"), x(r"(?m)^GN   Name=([^;{]+)").alias("gene"), x(r"(?m)^PE   (\d)").alias("existence"))


def accession(value: Column) -> Column:
    """SC17: accession out of a possible HTML anchor."""
    text = F.trim(F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")))
    inner = F.trim(F.regexp_extract(text, r"(?i)>([^<>]+)</a>", 1))
    return F.when(inner != "", inner).otherwise(F.trim(F.regexp_replace(text, "<[^>]+>", "")))


EVIDENCE_SCHEMA = "array<struct<genome_id:string,protein_id:string,start:bigint,end:bigint,strand:string,sequence:string,annotation:string,evidence:array<struct<source:string,identifier:string,description:string,supports:boolean,evidence_strength:string>>>>"


def parse_evidence_json(files: DataFrame) -> DataFrame:
    """SC18: evidence documents (``value`` holds one JSON array per sample) as one row per record.

    ``reject_reason`` marks samples that do not name exactly one genome.
    """
    p = files.select("sample_id", F.explode(F.from_json("value", EVIDENCE_SCHEMA)).alias("p"))
    one = p.groupBy("sample_id").agg((F.min("p.genome_id") == F.max("p.genome_id")).alias("one"))
    rows = p.join(one, "sample_id").select("sample_id", "one", "p.genome_id", "p.protein_id", F.explode_outer("p.evidence").alias("ev"))
    return rows.select("sample_id", F.concat_ws("|", "genome_id", "protein_id").alias("cohort_protein_id"), "ev.*", F.when(~F.coalesce("one", F.lit(False)), "SAMPLE_WITHOUT_ONE_GENOME").alias("reject_reason"))


def parse_comparison(lines: DataFrame) -> DataFrame:
    """SC19: comparison evidence with vocabulary and range rules."""
    cols = [("query", "string"), ("target", "string"), ("source_group", "string"), ("method", "string"), ("sequence_identity", "double"), ("coverage", "double"), ("confidence", "double")]
    bad = F.lit(False)
    for c in ("sequence_identity", "coverage", "confidence"):
        bad = bad | ~F.col(c).between(0, 1)
    return parse_table(lines, cols, {"UNKNOWN_SOURCE_GROUP": ~F.col("source_group").isin("phage", "bacteria", "eukaryote", "other"), "FRACTION_OUTSIDE_0_1": bad})


def benchmark_loci(rows: DataFrame) -> DataFrame:
    """SC20: curated benchmark loci with the rule they break, duplicates included."""
    key = ["genome_id", "s", "e", "strand"]
    twice = rows.groupBy(*key).agg(F.count("*").alias("n"))
    reason = (
        F.when(F.col("location").contains("join"), "COMPOUND_LOCATION").when((F.col("s") < 1) | (F.col("e") < F.col("s")), "BAD_COORDINATES").when(~F.col("strand").isin("+", "-"), "BAD_STRAND")
        .when(F.coalesce(F.trim("curated_by"), F.lit("")) == "", "MISSING_CURATOR").when(F.col("n") > 1, "DUPLICATE_LOCUS")
    )
    return rows.join(twice, key).withColumn("reject_reason", reason).drop("n")
