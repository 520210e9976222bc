"""Curation, reviews, audit chains and review queues (CU01-CU10, GM08-GM10, TX12)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virocohort.functions import labels as lb
from virocohort.operators.ordering import ordinal, with_neighbours
from virocohort.rules.fusion import CRITICAL_HALLMARKS

EDITABLE = ("product", "gene", "ec_number", "note")
GENESIS = "0" * 64
IDENTITY_TERMS = r"(?i)\b(phanotate|prodigal(?:[-_]gv)?|pharokka|prokka|hmmscan|mmseqs2?|diamond|phrogs?|vogdb|pfam|swiss-?prot)\b"


def apply_edits(annotations: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CU01: curated values over the annotation, and the edits that were refused with the reason.

    edits: protein_id, source_sha256, product, gene, note, evidence_reference, reviewer; the source
    checksum must be the one the edit was made against.  A new product also becomes the function.
    """
    e = edits.join(annotations.select("protein_id", F.col("source_sha256").alias("now_sha")), "protein_id", "left")
    named = ~F.lower(F.coalesce("product", F.lit("hypothetical protein"))).isin("hypothetical protein", "unknown function", "uncharacterized protein")
    reason = (
        F.when(F.col("now_sha").isNull(), "UNKNOWN_PROTEIN").when(F.col("now_sha") != F.col("source_sha256"), "SOURCE_CHECKSUM_MISMATCH")
        .when(named & (F.coalesce("evidence_reference", F.lit("")) == ""), "NAMED_PRODUCT_WITHOUT_EVIDENCE")
    )
    e = e.withColumn("refused", reason)
    good = e.where("refused is null").select("protein_id", F.col("product").alias("n_product"), F.col("gene").alias("n_gene"), F.col("note").alias("n_note"), "reviewer")
    out = annotations.join(good, "protein_id", "left")
    merged = out.select(
        "protein_id", F.coalesce("n_product", "product").alias("product"), F.coalesce("n_product", "proposed_function").alias("proposed_function"), F.coalesce("n_gene", "gene").alias("gene"), F.coalesce("n_note", "note").alias("note"),
        F.when(F.col("reviewer").isNotNull(), "MANUALLY_REVIEWED").otherwise("AUTOMATIC").alias("curation_state"), "reviewer")
    return merged, e.where("refused is not null").select("protein_id", "refused")


def audit_chain(events: DataFrame, chain: str, order: Sequence[str]) -> DataFrame:
    """CU02: hash-chained events: each checksum covers its payload and the checksum before it.

    A chain is sequential by definition, so each one is read once in order with a single checksum
    held between rows; different chains run in parallel.  ``payload`` is canonical JSON.
    """
    fields = [c for c in events.columns]
    payload = F.to_json(F.struct(*sorted(c for c in fields)))
    rows = events.withColumn("payload", payload).select(chain, *[c for c in order if c != chain], "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, previous = None, GENESIS
        for batch in batches:
            before, after = [], []
            for k, body in zip(batch[chain], batch["payload"]):
                if k != key:
                    key, previous = k, GENESIS
                before.append(previous)
                previous = hashlib.sha256((previous + "|" + body).encode()).hexdigest()
                after.append(previous)
            yield batch.assign(previous_sha256=before, sha256=after)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(chain).sortWithinPartitions(chain, *order).mapInPandas(run, kinds + ", previous_sha256 string, sha256 string")


def verify_chain(audit: DataFrame, chain: str, axis: str, order: Sequence[str], size: int = 20_000) -> DataFrame:
    """CU03: events whose checksum does not recompute or does not follow the event before it."""
    indexed = ordinal(audit, [chain], axis, order, "__i", size)
    linked = with_neighbours(indexed, [chain], "__i", 1, lambda f: {"__prev": F.lag("sha256").over(f.ordered)})
    follows = F.col("previous_sha256") == F.coalesce("__prev", F.lit(GENESIS))
    intact = F.sha2(F.concat_ws("|", "previous_sha256", "payload"), 256) == F.col("sha256")
    problem = F.when(~follows, "CHAIN_BROKEN").when(~intact, "CHECKSUM_MISMATCH")
    return linked.withColumn("problem", problem).where("problem is not null").drop("__i", "__prev")


def canonical_json(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def revise_submission(original: DataFrame, corrections: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """CU04: corrected records, and one audit row per changed field (protein_id, field, original, corrected)."""
    c = corrections.select("protein_id", *[F.col(f).alias("c_" + f) for f in fields])
    j = original.join(c, "protein_id", "left")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("original"), F.col("c_" + f).cast("string").alias("corrected")) for f in fields]))
    audit = j.select("protein_id", cells.alias("x")).select("protein_id", "x.*").where("corrected is not null and not (original <=> corrected)")
    revised = j.select(*[c for c in original.columns if c not in fields], *[F.coalesce("c_" + f, f).alias(f) for f in fields])
    return revised, audit


def attach_reviews(cases: DataFrame, reviews: DataFrame, verdicts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """CU05: reviews gathered per case with one adjudication, and reviews that fit no case or vocabulary."""
    ok = reviews.where(F.col("verdict").isin(*verdicts))
    per = ok.groupBy("case_id").agg(F.count("*").alias("review_count"), F.min("verdict").alias("lo"), F.max("verdict").alias("hi"))
    out = cases.join(per, "case_id", "left").select(
        *cases.columns, F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("adjudication"), F.when(F.col("lo").isNull(), "NOT_REVIEWED").when(F.col("lo") == F.col("hi"), "AGREED").otherwise("DISAGREEMENT").alias("review_state"))
    stray = ok.join(cases.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("UNKNOWN_CASE").alias("problem"))
    return out, stray.unionByName(reviews.where(~F.col("verdict").isin(*verdicts)).select("case_id", F.lit("UNKNOWN_VERDICT").alias("problem")))


def blind(records: DataFrame, case: Column, salt: str, text_columns: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """TX12: records without identity: salted case ids, tool names redacted, identifying columns gone."""
    if not salt:
        raise ValueError("a salt is required for a blinded export")
    hidden = F.concat(F.lit("BLIND_"), F.substring(F.sha2(F.concat(F.lit(salt), case), 256), 1, 20))
    out = records.withColumn("blinded_case_id", hidden).drop(*drop)
    for c in text_columns:
        out = out.withColumn(c, F.regexp_replace(c, IDENTITY_TERMS, "[REDACTED]"))
    return out


def review_cases(pairs: DataFrame, salt: str) -> DataFrame:
    """CU06: blinded A/B packets of unresolved pairs (genome_id, s, e, strand, tool_1, product_1, tool_2, product_2).

    Which tool is A follows from a salted hash of the locus, so the order is fixed but not guessable.
    """
    locus = F.concat_ws("|", "genome_id", F.col("s").cast("string"), F.col("e").cast("string"), "strand")
    h = F.sha2(F.concat(F.lit(salt), locus), 256)
    swap = F.substring(h, 1, 1) < "8"
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return pairs.select(F.concat(F.lit("CASE_"), F.substring(h, 1, 20)).alias("case_id"), "genome_id", "s", "e", "strand", pick("product_1", "product_2").alias("product_a"), pick("product_2", "product_1").alias("product_b"),
                        pick("tool_1", "tool_2").alias("key_a"), pick("tool_2", "tool_1").alias("key_b"))


def apply_reviews(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """CU07: completed reviews replace pending categories only; rows whose fixed fields changed are refused."""
    r = reviews.select("case_id", F.col("product").alias("r_product"), F.col("verdict"))
    j = rows.join(r, "case_id", "left")
    touched = F.col("verdict").isNotNull() & ~F.col("product").eqNullSafe(F.col("r_product"))
    pending = F.col("category") == lb.PENDING
    outcome = F.when(F.col("verdict").isNull(), "UNCHANGED").when(touched, "REFUSED_IMMUTABLE_FIELD").when(pending, "APPLIED").otherwise("IGNORED_NOT_PENDING")
    return j.select(*rows.columns, outcome.alias("outcome"), F.when(outcome == "APPLIED", F.col("verdict")).otherwise(F.col("category")).alias("final_category"))


def evidence_review(decisions: DataFrame, reviews: DataFrame, verdicts: Sequence[str]) -> DataFrame:
    """CU08: each decision reviewed exactly once against the very record and sequence it rests on."""
    per = reviews.groupBy("case_id").agg(F.count("*").alias("n"), F.min("sequence_sha256").alias("rs"), F.min("record_sha256").alias("rr"), F.min("verdict").alias("verdict"))
    j = decisions.join(per, "case_id", "full")
    problem = (
        F.when(F.col("sequence_sha256").isNull(), "UNKNOWN_CASE").when(F.col("n").isNull(), "NOT_REVIEWED").when(F.col("n") > 1, "REVIEWED_TWICE").when(F.col("rs") != F.col("sequence_sha256"), "SEQUENCE_CHANGED")
        .when(F.col("rr") != F.col("record_sha256"), "RECORD_CHANGED").when(~F.col("verdict").isin(*verdicts), "UNKNOWN_VERDICT").otherwise("OK")
    )
    return j.select("case_id", problem.alias("state"), F.when(problem == "OK", F.col("verdict")).alias("verdict"))


def unified_records(base: DataFrame, classified: DataFrame, curated: DataFrame, external: DataFrame) -> DataFrame:
    """CU10: one cohort record per protein: curated over classified over base, outside proposals counted.

    base: genome_id, protein_id, annotation; classified/curated: genome_id, protein_id, product;
    external: genome_id, protein_id, proposed_product.
    """
    key = ["genome_id", "protein_id"]
    c = classified.select(*key, F.col("product").alias("c_product"), "functional_state")
    u = curated.select(*key, F.col("product").alias("u_product"))
    x = external.groupBy(*key).agg(F.count("*").alias("proposals"), F.min("proposed_product").alias("first_proposal"))
    j = base.join(c, key, "full").join(u, key, "left").join(x, key, "left")
    product = F.coalesce("u_product", "c_product", "annotation")
    return j.select(F.concat_ws("|", *key).alias("record_id"), *key, product.alias("product"), F.coalesce("functional_state", F.lit("UNRESOLVED")).alias("functional_state"),
                    F.when(F.col("u_product").isNotNull(), "CURATED").when(F.col("c_product").isNotNull(), "CLASSIFIED").otherwise("BASE").alias("product_origin"), F.coalesce("proposals", F.lit(0)).alias("external_proposals"),
                    F.coalesce(lb.informative(F.col("first_proposal")) & lb.informative(product) & (lb.normalise_product(F.col("first_proposal")) != lb.normalise_product(product)), F.lit(False)).alias("external_conflict"))


def review_queue(classified: DataFrame, gene_calls: DataFrame, hallmarks: DataFrame) -> DataFrame:
    """GM08: function, gene-call and hallmark issues in one list with priority."""
    function = classified.where("functional_state in ('UNRESOLVED', 'CONFLICTING_EVIDENCE') or ambiguity_flags <> ''").select(
        "genome_id", "protein_id", F.lit("FUNCTION_ASSIGNMENT").alias("review_type"), F.when(F.col("functional_state") == "CONFLICTING_EVIDENCE", "HIGH").otherwise("MEDIUM").alias("priority"))
    calls = gene_calls.where("review_flag <> 'NONE'").select(
        "genome_id", "protein_id", F.lit("GENE_CALL").alias("review_type"), F.when(F.col("review_flag").isin("POSSIBLE_FALSE_CALL", "REVIEW_STRAND"), "HIGH").otherwise("MEDIUM").alias("priority"))
    marks = hallmarks.where("status <> 'DETECTED'").select(
        "genome_id", F.col("hallmark").alias("protein_id"), F.lit("HALLMARK_NOT_ESTABLISHED").alias("review_type"), F.when(F.col("hallmark").isin(*CRITICAL_HALLMARKS), "HIGH").otherwise("LOW").alias("priority"))
    return function.unionByName(calls).unionByName(marks).withColumnRenamed("protein_id", "subject")


def triage(decisions: DataFrame, selections: DataFrame, classified: DataFrame) -> DataFrame:
    """GM09: what a reviewer will meet, per genome."""
    conflict = F.col("decision_class").isin("STRAND_CONFLICT_UNRESOLVED", "SPLIT_MERGE_UNRESOLVED", "BOUNDARY_CONFLICT_UNRESOLVED", "INSUFFICIENT_COMPARATIVE_EVIDENCE")
    d = decisions.groupBy("genome_id").agg(F.count_if(conflict).alias("unresolved_conflicts"))
    s = selections.groupBy("genome_id").agg(
        F.count_if(F.col("selected_candidate").isNotNull()).alias("final_genes"), F.count_if("changed_from_legacy").alias("boundary_changes"),
        F.count_if(F.col("selection_rule") == "RESCUE_CANDIDATE_NOT_AUTOMATICALLY_SELECTED").alias("rescue_candidates"), F.count_if(F.col("review_priority") == "HIGH_PRIORITY_REVIEW").alias("high_priority"))
    u = classified.where("functional_state = 'UNRESOLVED' or review_flag = 'REVIEW_REQUIRED'").groupBy("genome_id").agg(F.count("*").alias("unresolved_functions"))
    return s.join(d, "genome_id", "full").join(u, "genome_id", "left").fillna(0)


def conflict_table(classified: DataFrame, external: DataFrame) -> DataFrame:
    """GM10: engine conflicts, and outside labels that differ from an informative product."""
    engine = classified.where("conflict").select("protein_id", F.lit("ENGINE_EVIDENCE_CONFLICT").alias("kind"), F.col("display_product").alias("current_product"), F.lit(None).cast("string").alias("proposed_product"))
    j = external.join(classified.select("protein_id", "display_product"), "protein_id")
    differ = lb.informative(F.col("display_product")) & (lb.normalise_product(F.col("display_product")) != lb.normalise_product(F.col("proposed_product")))
    outside = j.where(differ).select("protein_id", F.lit("EXTERNAL_LABEL_DIFFERENCE").alias("kind"), F.col("display_product").alias("current_product"), "proposed_product")
    return engine.unionByName(outside)
