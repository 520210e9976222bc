"""Nearest references and genome similarity (CG01-CG06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from virocohort.functions import sequence as sq
from virocohort.operators.families import top_per_group
from virocohort.operators.intervals import best_hsp_per_base
from virocohort.session import cut_lineage

SPECIES_PERCENT = 95.0


def nearest_references(distances: DataFrame, metadata: DataFrame, n: int = 10) -> DataFrame:
    """CG01: the ``n`` closest references per sample by (distance, p, reference, shared), with metadata.

    The rank limit is pushed below the shuffle, so a sample with most of the rows sends ``n`` rows
    per task.
    """
    order = [F.asc("distance"), F.asc("p_value"), F.asc("reference"), F.asc("shared")]
    return top_per_group(distances, ["sample_id"], order, n).join(metadata, "reference", "left")


def confirm_zero_distance(ranked: DataFrame, samples: DataFrame, references: DataFrame) -> DataFrame:
    """CG02: compare sequences only where the sketch distance is zero; say why otherwise."""
    zero = ranked.where("distance = 0").join(samples.select("sample_id", F.col("seq").alias("q")), "sample_id", "left").join(
        references.select("reference", F.col("seq").alias("r")), "reference", "left")
    checked = zero.select("sample_id", "reference", F.when(F.col("r").isNull(), "NOT_RUN_REFERENCE_SEQUENCE_UNAVAILABLE").otherwise(
        sq.equivalence(F.coalesce("q", F.lit("")), F.col("r"))).alias("c"))
    out = ranked.join(checked, ["sample_id", "reference"], "left")
    return out.withColumn("sequence_confirmation", F.when(F.col("distance") != 0, "NOT_RUN_MASH_DISTANCE_NONZERO").otherwise(F.col("c"))).drop("c")


def bidirectional_similarity(forward: DataFrame, backward: DataFrame, lengths: DataFrame) -> DataFrame:
    """CG03: length-normalised identity of both directions (HSP tables by pair_id; len_a, len_b)."""
    side = lambda df, x: best_hsp_per_base(df, ["pair_id"]).select("pair_id", F.col("identical").alias("id_" + x), F.col("aligned_bases").alias("al_" + x))
    out = lengths.join(side(forward, "a"), "pair_id", "left").join(side(backward, "b"), "pair_id", "left").fillna(0)
    return out.select(
        "pair_id", ((F.col("id_a") + F.col("id_b")) * 100.0 / (F.col("len_a") + F.col("len_b"))).alias("similarity_percent"),
        (F.col("al_a") * 100.0 / F.col("len_a")).alias("query_aligned_percent"), (F.col("al_b") * 100.0 / F.col("len_b")).alias("reference_aligned_percent"),
        (F.least("len_a", "len_b") / F.greatest("len_a", "len_b")).alias("length_ratio"))


def taxonomy_label(similarity: Column, ratio: Column, query_aligned: Column, reference_aligned: Column, genus_percent: Column) -> tuple[Column, Column]:
    """CG04: whether a numerical boundary may be discussed, and which; never an assignment."""
    eligible = F.coalesce((ratio >= 0.90) & (query_aligned >= 70.0) & (reference_aligned >= 70.0), F.lit(False))
    label = (
        F.when(similarity.isNull(), "NOT_CALCULATED").when(~eligible, "NUMERICAL_TAXONOMY_NOT_APPLICABLE_TO_PARTIAL_OR_POORLY_ALIGNED_QUERY")
        .when(similarity >= SPECIES_PERCENT, "ABOVE_95_PERCENT_WORKING_SPECIES_BOUNDARY_REQUIRES_ICTV_REVIEW").when(genus_percent.isNull(), "NO_FAMILY_SPECIFIC_GENUS_BOUNDARY_CONFIGURED")
        .when(similarity >= genus_percent, "ABOVE_CONFIGURED_FAMILY_GENUS_BOUNDARY_REQUIRES_ICTV_REVIEW").otherwise("BELOW_CONFIGURED_FAMILY_GENUS_BOUNDARY")
    )
    return eligible, label


def unique_references(rows: DataFrame) -> DataFrame:
    """CG05: one row per biological reference however many accessions describe it.

    rows: sample_id, rank, reference, distance, matching_hashes, description, host_genus, genus, family, sequence_confirmation.
    """
    key = ["sample_id", F.lower(F.trim(F.coalesce("description", F.lit("")))).alias("desc_key"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("host_genus", "genus", "family")]]
    best = F.min_by(F.struct("distance", "matching_hashes", "sequence_confirmation", "reference"), F.struct("distance", "rank"))
    g = rows.groupBy(*key).agg(best.alias("b"), F.array_join(F.array_sort(F.collect_set("reference")), ";").alias("reference_accessions"), F.count("*").alias("accessions"))
    parts = F.split("b.matching_hashes", "/", 2)
    full = (F.size(parts) == 2) & (parts[0] == F.get(parts, F.lit(1))) & ~parts[0].isin("", "0")
    relation = (
        F.when(F.coalesce(F.col("b.sequence_confirmation"), F.lit("")).startswith("CONFIRMED_"), "CONFIRMED_SEQUENCE_EQUIVALENT_REFERENCE")
        .when((F.col("b.distance") == 0) & full, "EXACT_MASH_SKETCH_MATCH").otherwise("NEAREST_NEIGHBOUR_SCREEN")
    )
    return g.select("sample_id", "desc_key", "host_genus", "genus", "family", "reference_accessions", "accessions", F.col("b.distance").alias("best_distance"), relation.alias("relationship"))


def annotated_references(hsps: DataFrame, lengths: DataFrame, min_coverage: float = 70.0, min_identity: float = 80.0) -> DataFrame:
    """CG06: references covering and matching enough of the query, base by base."""
    b = best_hsp_per_base(hsps, ["pair_id"]).join(lengths, "pair_id", "right").fillna(0)
    cov = 100.0 * F.col("aligned_bases") / F.col("len_a")
    ident = F.when(F.col("aligned_bases") > 0, 100.0 * F.col("identical") / F.col("aligned_bases")).otherwise(0.0)
    return b.select("pair_id", cov.alias("query_coverage_percent"), ident.alias("identity_percent"), ((cov >= min_coverage) & (ident >= min_identity)).alias("selected"))


def sketch(contigs: DataFrame, k: int = 16, size: int = 1000) -> DataFrame:
    """CG01: the ``size`` smallest hashes (48 bits of md5) of canonical words of each genome, whole sequences read.

    Written once: the words are cut and hashed once for all that reads a sketch, and no join sends it through the driver.
    """
    words = sq.explode_words(contigs.select("genome_id", F.upper("seq").alias("seq")), "seq", k).where(F.col("word").rlike("^[ACGT]+$"))
    word = F.least("word", sq.reverse_complement(F.col("word")))
    hashes = words.select("genome_id", word.alias("word")).distinct().select("genome_id", F.conv(F.substring(F.md5("word"), 1, 12), 16, 10).cast("bigint").alias("h")).distinct()
    return cut_lineage(top_per_group(hashes, ["genome_id"], [F.asc("h")], size, "r")).hint("merge")


def sketch_distances(samples: DataFrame, references: DataFrame, k: int = 16, size: int = 1000) -> DataFrame:
    """CG01: distance estimate of sample and reference sketches that share a hash.

    Of the two sketches together only the ``size`` smallest distinct hashes count.  Sketches list their hashes by rank
    ``r``: a shared hash with ranks i and j, the m-th shared one, is the (i + j - m)-th of the merged sketch, so pairs
    need their shared hashes alone.
    """
    a = samples.select(F.col("genome_id").alias("sample_id"), "h", F.col("r").alias("i"))
    b = references.select(F.col("genome_id").alias("reference"), "h", F.col("r").alias("j"))
    both = a.join(b, "h").withColumn("m", F.row_number().over(Window.partitionBy("sample_id", "reference").orderBy("h")))
    shared = both.where(F.col("i") + F.col("j") - F.col("m") <= size).groupBy("sample_id", "reference").agg(F.count("*").alias("shared"))
    every = both.groupBy("sample_id", "reference").agg(F.count("*").alias("common"))
    count = lambda df, x: df.groupBy(F.col("genome_id").alias(x)).agg(F.count("*").alias("n_" + x))
    out = shared.join(every, ["sample_id", "reference"]).join(count(samples, "sample_id"), "sample_id").join(count(references, "reference"), "reference")
    j = F.col("shared") / F.least(F.lit(size), F.col("n_sample_id") + F.col("n_reference") - F.col("common"))
    return out.select("sample_id", "reference", "shared", F.greatest(F.lit(0.0), -F.log(2 * j / (1 + j)) / k).alias("distance"))
