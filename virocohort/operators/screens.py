"""Review screens built on interval joins (IV15, IV17-IV23)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from virocohort.functions import sequence as sq
from virocohort.operators import intervals as iv
from virocohort.operators.ordering import ordinal, with_neighbours


def feature_overlaps(features: DataFrame, cds: DataFrame) -> DataFrame:
    """IV15: RNA or regulatory features against coding sequences, with the shared bases."""
    return iv.overlap_join(features.select("genome_id", "feature_id", F.col("s").alias("fs"), F.col("e").alias("fe")),
                           cds.select("genome_id", "model_id", "s", "e"), ["genome_id"], ("fs", "fe"), ("s", "e")).select(
        "genome_id", "feature_id", "model_id", F.col("overlap").alias("overlap_nt"))


def split_regulatory(features: DataFrame, cds: DataFrame) -> DataFrame:
    """IV15: features that overlap a coding sequence are rejected with the reason, others accepted."""
    hit = feature_overlaps(features, cds).select("genome_id", "feature_id").distinct().withColumn("__h", F.lit(True))
    out = features.join(hit, ["genome_id", "feature_id"], "left")
    return out.select(*features.columns, F.col("__h").isNull().alias("accepted"),
                      F.when(F.col("__h"), "REGULATORY_FEATURE_OVERLAPS_CDS").alias("reason"))


BLOCKS = "hsp_id {hsp}, genome_id string, reference_id string, orientation int, s_lo bigint, s_hi bigint, q_lo bigint, q_step int"


def aligned_blocks(hsps: DataFrame) -> DataFrame:
    """IV17: gap-free blocks of gapped alignments (hsp_id, genome_id, reference_id, qs, qe, ss, se, qseq, sseq): subject
    positions s_lo to s_hi, the query position of s_lo and the step (+1/-1) from there.

    An alignment is cut at its gaps within its own row, so rows grow with gaps and not with bases.  Columns that only one
    of the two texts has are left out; an alignment without a text has no block.
    """
    rows = hsps.where("qseq is not null and sseq is not null").select(
        "hsp_id", "genome_id", "reference_id", F.col("qs").cast("bigint"), F.col("ss").cast("bigint"),
        F.when(F.col("qe") >= F.col("qs"), 1).otherwise(-1).alias("qd"), F.when(F.col("se") >= F.col("ss"), 1).otherwise(-1).alias("sd"), "qseq", "sseq")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                n = min(len(row.qseq), len(row.sseq))
                q, t = (np.frombuffer(x[:n].encode("ascii", "replace"), np.uint8) != ord("-") for x in (row.qseq, row.sseq))
                edges = np.flatnonzero(np.diff((q & t).astype(np.int8), prepend=0, append=0))
                first, size = edges[::2], edges[1::2] - edges[::2]
                if not len(first):
                    continue
                # bases of each text before the columns in which blocks begin
                s = row.ss + row.sd * (np.cumsum(t, dtype=np.int64)[first] - 1)
                x = row.qs + row.qd * (np.cumsum(q, dtype=np.int64)[first] - 1)
                last = size - 1
                forward = row.sd > 0
                yield pd.DataFrame({
                    "hsp_id": row.hsp_id, "genome_id": row.genome_id, "reference_id": row.reference_id, "orientation": row.qd * row.sd,
                    "s_lo": s if forward else s - last, "s_hi": s + last if forward else s,
                    "q_lo": x if forward else x + row.qd * last, "q_step": row.qd * row.sd})

    return rows.mapInPandas(cut, BLOCKS.format(hsp=rows.schema["hsp_id"].dataType.simpleString()))


def project_reference_cds(blocks: DataFrame, reference_cds: DataFrame, cds: DataFrame, bin_size: int = 1000) -> DataFrame:
    """IV17: carry reference genes through the blocks of one alignment and compare with the called genes: one row for each aligned
    genome and gene of its reference, unmapped ones too.

    reference_cds: reference_id, gene, rs, re, rstrand (+1/-1); cds: genome_id, model_id, s, e, strand.
    """
    placed = iv.overlap_join(blocks, reference_cds, ["reference_id"], ("s_lo", "s_hi"), ("rs", "re"), bin_size)
    at = lambda place: F.max(F.when(F.col(place).between(F.col("s_lo"), F.col("s_hi")), F.col("q_lo") + F.col("q_step") * (F.col(place) - F.col("s_lo"))))
    whole = placed.groupBy("genome_id", "reference_id", "gene", "rs", "re", "rstrand", "hsp_id", "orientation").agg(
        F.sum("overlap").alias("n"), at("rs").alias("q0"), at("re").alias("q1")).where("n = re - rs + 1")
    shot = F.struct(F.least("q0", "q1").alias("s"), F.greatest("q0", "q1").alias("e"), (F.col("rstrand") * F.col("orientation")).alias("d"))
    per_gene = whole.groupBy("genome_id", "reference_id", "gene", "rs", "re").agg(F.min(shot).alias("lo"), F.max(shot).alias("hi"))
    single = per_gene.where("lo = hi").select("genome_id", "reference_id", "gene", "rs", "re", F.col("lo.s").alias("qs"), F.col("lo.e").alias("qe"),
                                              F.when(F.col("lo.d") == 1, "+").otherwise("-").alias("strand"))
    hits = iv.overlap_join(single, cds.select("genome_id", "model_id", "s", "e", "strand"), ["genome_id", "strand"], ("qs", "qe"), ("s", "e")).groupBy("genome_id", "reference_id", "gene").agg(
        F.count("*").alias("hits"), F.bool_or((F.col("s") == F.col("qs")) & (F.col("e") == F.col("qe"))).alias("exact"))
    aligned = blocks.select("genome_id", "reference_id").distinct()
    out = aligned.join(reference_cds.select("reference_id", "gene", "rs", "re"), "reference_id").join(
        per_gene.select("genome_id", "reference_id", "gene", (F.col("lo") != F.col("hi")).alias("ambiguous"), F.col("lo.s").alias("query_start"), F.col("lo.e").alias("query_end")),
        ["genome_id", "reference_id", "gene"], "left").join(hits, ["genome_id", "reference_id", "gene"], "left")
    status = (
        F.when(F.col("ambiguous").isNull(), "UNMAPPABLE_REFERENCE_CDS")
        .when(F.col("ambiguous"), "AMBIGUOUS_REFERENCE_MAPPING")
        .when(F.col("query_end") - F.col("query_start") != F.col("re") - F.col("rs"), "INDEL_REQUIRES_REVIEW")
        .when(F.col("exact"), "EXACT_BOUNDARY_SUPPORT")
        .when(F.col("hits") > 0, "BOUNDARY_DISAGREEMENT")
        .otherwise("POSSIBLE_MISSED_CDS")
    )
    return out.select("genome_id", "reference_id", "gene", "rs", "re", "query_start", "query_end", status.alias("status"))


def frameshift_candidates(cds: DataFrame, hits: DataFrame, max_gap: int = 100) -> DataFrame:
    """IV18: neighbours on a strand, in different frames, hit by consecutive parts of one subject.

    hits: model_id, source, target, subject_start, subject_end, evalue.
    """
    keys = ["genome_id", "strand"]
    ordered = ordinal(cds.select(*keys, "model_id", "s", "e"), keys, "s", ["s", "e", "model_id"])
    pairs = with_neighbours(ordered, keys, "idx", 1, lambda f: {"nxt": F.lead(F.struct("model_id", "s", "e")).over(f.ordered)}).where("nxt is not null")
    plus = F.col("strand") == "+"
    here = F.struct("model_id", "s", "e")
    pairs = pairs.select("genome_id", "strand", F.when(plus, here).otherwise(F.col("nxt")).alias("a"), F.when(plus, F.col("nxt")).otherwise(here).alias("b"))
    gap = F.when(plus, F.col("b.s") - F.col("a.e") - 1).otherwise(F.col("a.s") - F.col("b.e") - 1)
    frame = lambda x: F.when(plus, (F.col(x + ".s") - 1) % 3).otherwise(F.col(x + ".e") % 3)
    pairs = pairs.withColumn("gap_nt", gap).where(F.col("gap_nt").between(-30, max_gap) & (frame("a") != frame("b")))
    side = lambda x: hits.where("evalue <= 1e-5").select(F.col("model_id").alias(x + "_id"), "source", "target", F.col("subject_start").alias(x + "_ss"), F.col("subject_end").alias(x + "_se"))
    found = pairs.select("genome_id", F.col("a.model_id").alias("x_id"), F.col("b.model_id").alias("y_id"), "gap_nt").join(side("x"), "x_id").join(side("y"), ["y_id", "source", "target"])
    return found.where("x_ss < y_ss and x_se <= y_ss + 10").select(
        "genome_id", F.col("x_id").alias("first_cds"), F.col("y_id").alias("second_cds"), "source", "target", "gap_nt")


def slippage_review(alerts: DataFrame, cds: DataFrame) -> DataFrame:
    """IV19: alerts attached to both genes, never asserted."""
    per = alerts.select("genome_id", F.explode(F.array("first_cds", "second_cds")).alias("model_id")).groupBy("genome_id", "model_id").agg(F.count("*").alias("slippage_alerts"))
    return cds.select("genome_id", "model_id").join(per, ["genome_id", "model_id"], "left").select(
        "genome_id", "model_id", F.coalesce("slippage_alerts", F.lit(0)).alias("slippage_alerts"),
        F.when(F.col("slippage_alerts") > 0, "REVIEW_REQUIRED_NOT_ASSERTED").alias("status"))


def nearest_start(points: DataFrame, calls: DataFrame, keys: list[str], point_id: str, size: int = 1000) -> DataFrame:
    """Call whose start lies nearest each point's start; of equals the smaller start, then id.

    A bin answers for itself; the closest call of the nearest filled bin on either side covers the rest.
    """
    b = calls.select(*keys, F.col("model_id").alias("call_id"), F.col("s").alias("cs")).withColumn("bin", F.floor(F.col("cs") / size))
    per = b.groupBy(*keys, "bin").agg(F.min(F.struct("cs", "call_id")).alias("first"),
                                     F.max(F.struct(F.col("cs"), F.col("call_id"))).alias("top"))
    last = b.join(per.select(*keys, "bin", F.col("top.cs").alias("cs")), [*keys, "bin", "cs"]).groupBy(*keys, "bin").agg(F.min(F.struct("cs", "call_id")).alias("last"))
    per = per.select(*keys, "bin", "first").join(last, [*keys, "bin"])
    order = Window.partitionBy(*keys).orderBy("bin")
    spans = per.select(*keys, "bin", "first", "last", F.lead("bin").over(order).alias("next"), F.lead("first").over(order).alias("after"), F.lag("last").over(order).alias("before"))
    edge = points.groupBy(*keys).agg(F.max(F.floor(F.col("s") / size)).alias("top_bin"), F.min(F.floor(F.col("s") / size)).alias("low_bin"))
    spans = spans.join(edge, keys).withColumn("until", F.coalesce(F.col("next") - 1, F.greatest("bin", "top_bin")))
    # bins from one filled bin to just before the next; the first one also serves the bins below it
    begin = F.when(F.col("before").isNull(), F.least("bin", "low_bin")).otherwise(F.col("bin"))
    served = spans.withColumn("slot", F.explode(F.sequence(begin, "until"))).select(
        *keys, F.col("slot").alias("bin"),
        F.when(F.col("slot") > F.col("bin"), F.col("last")).when(F.col("slot") == F.col("bin"), F.col("before")).alias("lo"),
        F.when(F.col("slot") < F.col("bin"), F.col("first")).otherwise(F.col("after")).alias("hi"))
    pts = points.select(*keys, point_id, F.col("s").alias("ps")).withColumn("bin", F.floor(F.col("ps") / size))
    flat = lambda side: pts.join(served, [*keys, "bin"]).where(side + " is not null").select(*keys, point_id, "ps", side + ".cs", side + ".call_id")
    inside = pts.join(b, [*keys, "bin"]).select(*keys, point_id, "ps", "cs", "call_id")
    every = inside.unionByName(flat("lo")).unionByName(flat("hi"))
    best = F.min(F.struct(F.abs(F.col("cs") - F.col("ps")).alias("d"), F.col("cs"), F.col("call_id")))
    return every.groupBy(*keys, point_id).agg(best.alias("n")).select(*keys, point_id, F.col("n.call_id").alias("nearest_call"), F.col("n.d").alias("start_distance"))


def sentinel_stages(sentinels: DataFrame, calls: DataFrame, final: DataFrame, have_decisions: bool = True, have_reconciliation: bool = True) -> DataFrame:
    """IV20: how far each expected interval got: final, dropped at a stage, or never called."""
    slim = sentinels.select("genome_id", "sentinel_id", F.col("s").alias("zs"), F.col("e").alias("ze"))
    touch = lambda t: iv.overlap_join(slim, t.select("genome_id", "s", "e", *[c for c in ("provider",) if c in t.columns]), ["genome_id"], ("zs", "ze"), ("s", "e"))
    raw = touch(calls).groupBy("genome_id", "sentinel_id").agg(
        F.array_join(F.array_sort(F.collect_set("provider")), ";").alias("callers"), F.count("*").alias("overlapping_calls"))
    kept = touch(final).select("genome_id", "sentinel_id").distinct().withColumn("final", F.lit(True))
    called = "DROPPED_AT_SELECTION_OR_ADJUDICATION" if have_decisions else "DROPPED_AT_RECONCILIATION_OR_LATER" if have_reconciliation else "RAW_CALL_PRESENT_STAGE_UNKNOWN"
    stage = F.when(F.col("final"), "FINAL_SELECTED").when(F.col("callers").isNotNull(), called).otherwise("NEVER_CALLED_BY_AVAILABLE_CALLER")
    return slim.join(raw, ["genome_id", "sentinel_id"], "left").join(kept, ["genome_id", "sentinel_id"], "left").select(
        "genome_id", "sentinel_id", stage.alias("stage"), F.coalesce("callers", F.lit("")).alias("callers"), F.coalesce("overlapping_calls", F.lit(0)).alias("overlapping_calls"))


def spanin_pairs(genes: DataFrame, size: int = 1000) -> DataFrame:
    """IV21: unambiguous inner/outer spanin pairs.

    genes: genome_id, model_id, s, e, strand, name, outer_support.  A member seen in two candidate
    pairs settles nothing, so only pairs whose both members occur once are kept.
    """
    keys = ["genome_id", "strand"]
    up = genes.where(F.col("name").isin("Rz-like spanin", "spanin", "Spanin")).select(*keys, F.col("model_id").alias("u"), F.col("s").alias("us"), F.col("e").alias("ue"))
    down = genes.where(F.col("name").isin("Rz-like spanin", "Rz1-like spanin", "spanin", "Spanin") & F.col("outer_support")).select(
        *keys, F.col("model_id").alias("d"), F.col("s").alias("ds"), F.col("e").alias("de"))
    near = iv.overlap_join(up, down, keys, ("us", "ue"), ("ds", "de"), size, slack=16).where("u <> d")
    plus = F.col("strand") == "+"
    gap = F.when(plus, F.col("ds") - F.col("ue") - 1).otherwise(F.col("us") - F.col("de") - 1)
    shift = F.when(plus, F.col("ds") - F.col("us")).otherwise(F.col("ue") - F.col("de"))
    near = near.withColumn("gap_nt", gap).withColumn("relative_frame", F.pmod(shift, F.lit(3)))
    pairs = near.where((shift > 0) & (((F.col("gap_nt") < 0) & (F.col("relative_frame") == 1)) | F.col("gap_nt").between(0, 15)))
    seen = pairs.select("genome_id", F.explode(F.array("u", "d")).alias("m")).groupBy("genome_id", "m").agg(F.count("*").alias("n")).where("n = 1")
    once = lambda c: seen.select("genome_id", F.col("m").alias(c))
    return pairs.join(once("u"), ["genome_id", "u"], "left_semi").join(once("d"), ["genome_id", "d"], "left_semi").select(
        "genome_id", F.col("u").alias("inner_id"), F.col("d").alias("outer_id"), "gap_nt", "relative_frame")


def outer_support(protein: Column, evidence_text: Column, source: Column, identifier: Column, evalue: Column, coverage: Column) -> tuple[Column, Column]:
    """IV21: lipobox support of a protein, and family support of one evidence row."""
    motif, at = sq.lipobox(protein)
    named = evidence_text.rlike(r"(?i)\b(?:Rz1|o-spanin)\b|outer[- ]membrane spanin|spanin.*outer[- ]membrane")
    listed = (F.lower(source) == "phrogs") & (F.lower(identifier) == "phrog_5672")
    return at > 0, (evalue <= 1e-5) & (coverage >= 0.5) & (named | listed)


def short_cds_review(primary: DataFrame, secondary: DataFrame, limit: int = 100) -> DataFrame:
    """IV22: calls under ``limit`` bases: repeated by the second caller, disputed, or possibly missed."""
    key = ["genome_id", "s", "e", "strand"]
    own = primary.where(F.col("e") - F.col("s") + 1 < limit).join(secondary.select(*key).distinct().withColumn("__x", F.lit(True)), key, "left").select(
        "genome_id", "model_id", F.lit("PRIMARY").alias("source"), F.when(F.col("__x"), "EXACT_SECONDARY_SUPPORT").otherwise("REVIEW_SHORT_PRIMARY_CDS").alias("assessment"))
    other = secondary.where(F.col("e") - F.col("s") + 1 < limit).join(primary.select(*key).distinct(), key, "left_anti")
    hit = iv.overlap_join(other.select("genome_id", "strand", "model_id", "s", "e"), primary.select("genome_id", "strand", F.col("s").alias("ps"), F.col("e").alias("pe")),
                          ["genome_id", "strand"], ("s", "e"), ("ps", "pe")).select("genome_id", "model_id").distinct().withColumn("__o", F.lit(True))
    only = other.join(hit, ["genome_id", "model_id"], "left").select(
        "genome_id", "model_id", F.lit("SECONDARY_ONLY").alias("source"), F.when(F.col("__o"), "DISPUTED_BOUNDARY").otherwise("POSSIBLE_MISSED_SHORT_CDS").alias("assessment"))
    return own.unionByName(only)


def alternative_codes(calls: DataFrame) -> DataFrame:
    """IV23: translation tables seen by the second caller, per genome."""
    tables = F.array_sort(F.collect_set("translation_table"))
    out = calls.groupBy("genome_id").agg(tables.alias("t"), F.count_if(F.col("translation_table") != 11).alias("alternative_calls"))
    return out.select("genome_id", F.array_join("t", ",").alias("observed_tables"),
                      F.array_join(F.filter("t", lambda x: x != 11), ",").alias("alternative_tables"), "alternative_calls",
                      F.when(F.col("alternative_calls") > 0, "REVIEW_REQUIRED").otherwise("NO_ALTERNATIVE_IN_NATIVE_CALLS").alias("status"))
