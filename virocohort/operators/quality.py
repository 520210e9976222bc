"""Quality control of genes, genomes and runs (QC01-QC15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virocohort.functions import sequence as sq
from virocohort.functions.labels import sanitise_product
from virocohort.operators.intervals import covered_length, neighbour_overlaps
from virocohort.operators.orf import cds_problems
from virocohort.rules import genetics as g

# severity of each finding code (fixed values)
ERRORS = ("coordinate_out_of_range", "invalid_strand", "cds_sequence_mismatch", "cds_length_not_multiple_of_three", "translation_mismatch", "internal_stop_codon")
INFOS = ("boundary_adjacent_cds", "shared_cds_boundary")
REQUIRED_METADATA = ("organism", "host", "isolation_source", "authors", "submitter_name", "submitter_email")
# topics of the submission questionnaire (fixed values)
QUESTIONS = (
    "Sequencing and coverage", "Genome completeness and physical termini", "Ambiguous bases and potential frameshifts", "Co-linearity and assembly artefacts",
    "Structural annotation and small ORFs", "CDS start-site curation", "Functional evidence", "Lysogeny, toxins and AMR screening", "Regulatory elements and noncoding RNA",
    "Isolate/prophage/environmental source", "Phage name and locus tags", "Submission cleanup", "Taxonomic assignment", "Database updates and reproducibility",
)


class GateError(ValueError):
    """A table broke a uniqueness, vocabulary or completeness rule."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """QC12: keys that occur more than once; counts combine before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def bad_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """QC12: values outside a vocabulary, nulls included."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(column).agg(F.count("*").alias("occurrences"))


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """QC12: required columns with empty cells."""
    counts = df.agg(*[F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "missing").where("missing > 0")


def require_empty(violations: DataFrame, rule: str) -> None:
    """Stop with an example when a violation table has rows."""
    example = violations.limit(3).collect()
    if example:
        raise GateError(f"{rule}: {[r.asDict() for r in example]}")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    require_empty(duplicate_keys(df, keys), f"duplicate key {list(keys)}")


def assert_allowed(df: DataFrame, column: str, allowed: Sequence[str]) -> None:
    require_empty(bad_values(df, column, allowed), f"value of {column} outside {list(allowed)}")


def audit_cds(models: DataFrame, contigs: DataFrame) -> DataFrame:
    """QC01: one row per finding (genome_id, model_id, code, severity).

    models: genome_id, model_id, s, e, strand, cds, protein.
    """
    # a plan takes a sequence for a short text and would send all of them through the driver
    m = models.join(contigs.select("genome_id", "seq", F.length("seq").alias("n")).hint("merge"), "genome_id")
    inside = (F.col("s") >= 1) & (F.col("s") <= F.col("e")) & (F.col("e") <= F.col("n"))
    strand = F.col("strand").isin("+", "-")
    m = m.withColumn("obs", sq.cds_of(F.col("seq"), F.col("s"), F.col("e"), F.col("strand"))).drop("seq").withColumn("tr", sq.translate(F.col("cds")))
    ok, long = inside & strand, F.length("cds") >= 6
    first, last = F.substring("cds", 1, 3), F.substring("cds", -3, 3)
    codes = F.array_compact(F.array(
        F.when(~inside, "coordinate_out_of_range"), F.when(inside & ~strand, "invalid_strand"), F.when(ok & (F.col("obs") != F.col("cds")), "cds_sequence_mismatch"),
        F.when(ok & (F.length("cds") % 3 != 0), "cds_length_not_multiple_of_three"), F.when(ok & (F.col("protein") != F.col("tr")), "translation_mismatch"),
        F.when(ok & F.col("tr").contains("*"), "internal_stop_codon"), F.when(ok & ((F.col("s") == 1) | (F.col("e") == F.col("n"))), "boundary_adjacent_cds"),
        F.when(ok & long & ~first.isin(*g.CANONICAL_STARTS) & (F.col("e") != F.col("n")), "noncanonical_start_codon"),
        F.when(ok & long & ~last.isin(*g.STOPS) & (F.col("s") != 1), "missing_terminal_stop_codon"), F.when(ok & ~long, "very_short_cds")))
    found = m.select("genome_id", "model_id", F.explode(codes).alias("code"))
    return found.withColumn("severity", F.when(F.col("code").isin(*ERRORS), "error").when(F.col("code").isin(*INFOS), "info").otherwise("warning"))


def genome_rollup(findings: DataFrame, models: DataFrame, contigs: DataFrame, min_density: float = 85.0) -> DataFrame:
    """QC02: counts, coding density and status per genome, gene overlaps included."""
    kinds = neighbour_overlaps(models.select("genome_id", "model_id", "s", "e", "strand"), ["genome_id"], "model_id")
    touch = kinds.groupBy("genome_id").agg(F.count_if(F.col("overlap_type") == "shared_boundary").alias("shared"), F.count_if(F.col("overlap_type") != "shared_boundary").alias("overlapping"))
    lengths = contigs.select("genome_id", F.length("seq").cast("bigint").alias("sequence_length"), F.upper("seq").contains("N").alias("has_n"))
    valid = models.join(lengths.hint("merge"), "genome_id").where("s >= 1 and s <= e and e <= sequence_length")
    density = covered_length(valid, ["genome_id"])
    per = findings.groupBy("genome_id").agg(*[F.count_if(F.col("severity") == s).alias(s + "s") for s in ("error", "warning", "info")])
    n = models.groupBy("genome_id").agg(F.count("*").alias("predicted_cds"))
    out = lengths
    for side in (n, per, touch, density):  # a row a genome each
        out = out.join(side.hint("merge"), "genome_id", "left")
    out = out.fillna(0)
    pct = 100.0 * F.col("covered") / F.col("sequence_length")
    warnings = F.col("warnings") + F.col("overlapping") + F.col("has_n").cast("int") + (pct < min_density).cast("int")
    out = out.withColumn("all_warnings", warnings)
    return out.select("genome_id", "sequence_length", "predicted_cds", F.col("covered").alias("coding_bases"), pct.alias("coding_density_percent"), "errors", F.col("all_warnings").cast("bigint").alias("warnings"),
                      (F.col("infos") + F.col("shared")).alias("infos"), F.when(F.col("errors") > 0, "failed").when(F.col("all_warnings") > 0, "review_required").otherwise("passed").alias("status"))


def presubmission(models: DataFrame, contigs: DataFrame) -> DataFrame:
    """QC03: submission findings per gene.

    models: genome_id, model_id, s, e, strand, cds, protein, partial_5, partial_3, codon_start, mock.
    """
    m = models.join(contigs.select("genome_id", "seq", F.length("seq").alias("n")), "genome_id")
    inside = (F.col("s") >= 1) & (F.col("s") <= F.col("e")) & (F.col("e") <= F.col("n"))
    m = m.withColumn("inside", inside).withColumn("obs", sq.cds_of(F.col("seq"), F.col("s"), F.col("e"), F.col("strand"))).drop("seq")
    m = m.withColumn("plain", sq.translate(F.col("cds"))).withColumn("strict", sq.translate_strict(F.col("cds")))
    plus, known, long = F.col("strand") == "+", F.col("strand").isin("+", "-"), F.length("cds") >= 6
    five = F.when(plus, F.col("s") == 1).otherwise(F.col("e") == F.col("n"))
    three = F.when(plus, F.col("e") == F.col("n")).otherwise(F.col("s") == 1)
    start, stop = F.substring("cds", 1, 3).isin(*g.STARTS), F.substring("cds", -3, 3).isin(*g.STOPS)
    p5, p3 = F.col("partial_5"), F.col("partial_3")
    tests = [
        (~F.col("inside"), "coordinate_out_of_range", "error"), (F.col("inside") & known & ((p5 & ~five) | (p3 & ~three)), "NCBI_PARTIAL_LOCATION", "error"),
        (F.col("inside") & ~known, "invalid_strand", "error"), (F.col("inside") & (F.col("obs") != F.col("cds")), "cds_fasta_mismatch", "error"),
        (F.col("inside") & (F.length("cds") % 3 != 0) & ~(p5 | p3), "NCBI_CDS_FRAME", "error"), (F.col("inside") & ((F.col("protein") == "") | F.col("protein").contains("*")), "invalid_translation", "error"),
        (F.col("inside") & ~F.col("protein").isin(F.col("plain"), F.col("strict")), "translation_mismatch", "error"), (F.col("inside") & known & long & ~start & ~p5, "NCBI_CDS_START", "error"),
        (F.col("inside") & known & long & ~start, "noncanonical_start_codon", "warning"), (F.col("inside") & known & long & ~stop & ~p3, "NCBI_CDS_NOSTOP", "error"),
        (F.col("inside") & known & long & ~stop & p3, "NCBI_CDS_NOSTOP", "warning"), (F.col("inside") & known & long & ~stop & ~p3 & three, "POSSIBLE_ORIGIN_CROSSING_CDS", "warning"),
        (F.col("inside") & F.col("mock"), "mock_or_unsupported_function", "warning"),
    ]
    found = F.explode(F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for t, c, s in tests])))
    rows = m.select("genome_id", "model_id", found.alias("f")).select("genome_id", "model_id", "f.code", "f.severity")
    twice = duplicate_keys(models, ["genome_id", "model_id"]).select("genome_id", "model_id", F.lit("duplicate_protein_id").alias("code"), F.lit("error").alias("severity"))
    return rows.unionByName(twice)


def checklist(facts: DataFrame) -> DataFrame:
    """QC04: the fourteen review questions per genome, and the worst answer.

    facts: genome_id and booleans anomalies, rescue_audit, bad_cds, partial_cds, diverse_evidence,
    bad_regulatory, missing_metadata, bad_tags, bad_products, provenance.
    """
    warn = lambda c: F.when(c, "WARN").otherwise("PASS")
    fail = lambda c, other="PASS": F.when(c, "FAIL").otherwise(other)
    answers = [
        F.lit("WARN"), F.lit("WARN"), warn(F.col("anomalies")), F.lit("WARN"), warn(~F.col("rescue_audit")), F.when(F.col("bad_cds"), "FAIL").otherwise(warn(F.col("partial_cds"))), warn(~F.col("diverse_evidence")),
        F.lit("WARN"), fail(F.col("bad_regulatory"), "WARN"), warn(F.col("missing_metadata")), fail(F.col("bad_tags"), "WARN"), fail(F.col("bad_products")), F.lit("WARN"), warn(~F.col("provenance")),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("question"), F.lit(q).alias("criterion"), a.alias("status")) for i, (q, a) in enumerate(zip(QUESTIONS, answers))]))
    return facts.select("genome_id", rows.alias("r")).select("genome_id", "r.*")


def checklist_status(rows: DataFrame) -> DataFrame:
    rank = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return rows.groupBy("genome_id").agg(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), rank + 1).alias("status"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "WARN").alias("warned"))


def locus_tags(genes: DataFrame) -> DataFrame:
    """QC05: syntax, uniqueness and gap-free numbering of locus tags per genome."""
    good = F.col("locus_tag").rlike(r"^[A-Za-z][A-Za-z0-9]*_\d+$")
    number = F.regexp_extract("locus_tag", r"(\d+)$", 1).cast("bigint")
    return genes.groupBy("genome_id").agg(
        F.count_if(~good).alias("bad_tags"), (F.count("*") - F.count_distinct("locus_tag")).alias("duplicate_tags"),
        ((F.max(number) - F.min(number) + 1) == F.count("*")).alias("contiguous"))


def evidence_diversity(hits: DataFrame) -> DataFrame:
    """QC06: whether a protein has both sequence and profile evidence."""
    return hits.where("supports").groupBy("protein_id").agg(
        F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"),
        (F.bool_or(F.col("modality").isin("sequence_similarity", "phage_orthology")) & F.bool_or(F.col("modality").isin("domain", "phage_profile_hmm", "viral_orthology"))).alias("sequence_and_profile"))


def missing_metadata(metadata: DataFrame, required: Sequence[str] = REQUIRED_METADATA) -> DataFrame:
    """QC07: required fields without a value."""
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in required]))
    return metadata.select("genome_id", F.array_join(gaps, ";").alias("missing_fields"), F.size(gaps).alias("missing_count"))


def artifact_consistency(tables: dict[str, DataFrame], id_col: str = "protein_id") -> DataFrame:
    """QC08: ids absent from some of the artifacts of a run, with the artifacts that lack them."""
    long = None
    for name, df in tables.items():
        part = df.select(id_col).distinct().withColumn("artifact", F.lit(name))
        long = part if long is None else long.unionByName(part)
    seen = long.groupBy(id_col).agg(F.collect_set("artifact").alias("have"))
    lacking = F.array_except(F.array(*map(F.lit, tables)), F.col("have"))
    return seen.where(F.size(lacking) > 0).select(id_col, F.array_join(F.array_sort(lacking), ";").alias("missing_from"))


def codon_verification(models: DataFrame, contigs: DataFrame) -> DataFrame:
    """QC09: export check of every gene: codon problems, and partial flags that do not reach an edge."""
    n = contigs.select("genome_id", F.length("seq").alias("n"))
    plus = F.col("strand") == "+"
    five = F.when(plus, F.col("s") == 1).otherwise(F.col("e") == F.col("n"))
    three = F.when(plus, F.col("e") == F.col("n")).otherwise(F.col("s") == 1)
    edge = models.join(n, "genome_id").select("genome_id", "model_id", ((F.col("partial_5") & ~five) | (F.col("partial_3") & ~three)).alias("partial_inside"))
    out = cds_problems(models, contigs).join(edge, ["genome_id", "model_id"])
    status = F.when((F.col("problems") == "") & ~F.col("partial_inside"), "PASS").otherwise("FAIL")
    return out.select("genome_id", "model_id", "problems", "partial_inside", status.alias("status"))


def reference_qc(proteins: DataFrame) -> DataFrame:
    """QC10: metric rows of a reference protein table (FM21)."""
    metrics = {"total_proteins": F.count("*"), "missing_mapping": F.count_if("missing_mapping"), "missing_metadata": F.count_if("missing_metadata"),
               "predicted_uncharacterized": F.count_if(F.col("annotation_state") == "PREDICTED_UNCHARACTERIZED")}
    rows = proteins.agg(*[v.alias(k) for k, v in metrics.items()]).unpivot([], list(metrics), "metric", "value")
    return rows.withColumn("status", F.when(F.col("metric").startswith("missing") & (F.col("value") > 0), "REVIEW").otherwise("OK"))


def rna_features(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """QC11: problems of RNA features (seqid, type, s, e, strand, product, source) and their stable id."""
    key = ["seqid", "type", "s", "e", "strand"]
    twice = duplicate_keys(features, key)
    f = features.join(lengths.select(F.col("genome_id").alias("seqid"), "genome_length"), "seqid", "left").join(twice, key, "left")
    bad = F.array_compact(F.array(
        F.when(~F.col("type").isin("tRNA", "tmRNA", "rRNA", "ncRNA"), "UNSUPPORTED_TYPE"), F.when(F.col("genome_length").isNull(), "UNKNOWN_SEQUENCE"),
        F.when(~((F.col("s") >= 1) & (F.col("s") <= F.col("e")) & (F.col("e") <= F.col("genome_length"))), "OUT_OF_BOUNDS"), F.when(~F.col("strand").isin("+", "-"), "BAD_STRAND"),
        F.when(F.col("occurrences").isNotNull(), "DUPLICATE"), F.when((F.coalesce("source", F.lit("")) == "") | (F.coalesce("product", F.lit("")) == ""), "NO_PROVENANCE"), F.when(F.col("product").rlike(r"[\x00-\x1f]"), "PRODUCT_NOT_PRINTABLE")))
    return f.select(*key, "product", sq.content_id("PM_RNA_", "seqid", "type", F.col("s").cast("string"), F.col("e").cast("string"), "strand", width=12).alias("feature_id"), F.array_join(bad, ";").alias("problems"))


def readiness(state: DataFrame) -> DataFrame:
    """QC13: submission ladder (errors, warnings, missing_fields, review_required, external_state)."""
    step = (
        F.when((F.col("errors") > 0) | (F.col("external_state") == "FAILED"), "VALIDATION_FAILED").when(F.col("missing_fields") != "", "INCOMPLETE_METADATA").when(F.col("review_required"), "REQUIRES_REVIEW")
        .when(F.col("external_state").isNull(), "PENDING_EXTERNAL_VALIDATION").when(F.col("warnings") > 0, "READY_WITH_WARNINGS").otherwise("READY")
    )
    return state.select("genome_id", step.alias("readiness"), "missing_fields")


def review_candidates(short_orfs: DataFrame, slippage: DataFrame, exclusions: DataFrame, genes: DataFrame) -> DataFrame:
    """QC14: one queue of short ORFs with homology, split-hit spans and strictly excluded genes."""
    orf = short_orfs.where("not accepted and has_homology").select("genome_id", F.col("cand_id").alias("candidate_id"), "s", "e", F.lit("SHORT_ORF_WITH_HOMOLOGY").alias("reason"))
    at = lambda x: genes.select(F.col("model_id").alias(x), F.col("s").alias("s_" + x), F.col("e").alias("e_" + x))
    span = slippage.join(at("first_cds"), "first_cds").join(at("second_cds"), "second_cds").select(
        "genome_id", F.concat_ws("|", "first_cds", "second_cds").alias("candidate_id"), F.least("s_first_cds", "s_second_cds").alias("s"), F.greatest("e_first_cds", "e_second_cds").alias("e"), F.lit("POSSIBLE_SLIPPAGE").alias("reason"))
    cut = exclusions.where("excluded").select("genome_id", F.col("model_id").alias("candidate_id"), "s", "e", F.lit("STRICT_PRECISION_EXCLUSION").alias("reason"))
    return orf.unionByName(span).unionByName(cut)


def genome_summary(contigs: DataFrame, models: DataFrame, rna: DataFrame) -> DataFrame:
    """QC15: length, GC, counts and start-codon histogram per genome (models carry start_codon, tier)."""
    codon = models.groupBy("genome_id", "start_codon").agg(F.count("*").alias("n"))
    hist = codon.groupBy("genome_id").agg(F.sum("n").alias("cds_count"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "start_codon", F.col("n").cast("string")))), ";").alias("start_codons"))
    tiers = models.groupBy("genome_id").agg(*[F.count_if(F.col("tier") == t).alias("tier_" + t) for t in ("high", "medium", "low")])
    rnas = rna.groupBy("genome_id").agg(F.count("*").alias("rna_count"))
    base = contigs.select("genome_id", F.length("seq").alias("length_nt"), (100 * sq.gc_fraction(F.upper("seq"))).alias("gc_percent"))
    return base.join(hist, "genome_id", "left").join(tiers, "genome_id", "left").join(rnas, "genome_id", "left").fillna(0).fillna("")


def unclean_products(genes: DataFrame) -> DataFrame:
    """Products that submission clean-up would change."""
    return genes.where(sanitise_product(F.col("product")) != F.col("product"))
