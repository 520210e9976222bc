"""Threshold policies, merging, caching and summaries of search evidence (EV01-EV18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virocohort.functions.columns import literal_map
from virocohort.rules import fusion as rules

SOURCE_SPELLINGS = {"swissprot": "Swiss-Prot", "swiss-prot": "Swiss-Prot", "phrog": "PHROGs", "phrogs": "PHROGs", "vog": "VOGDB", "vogdb": "VOGDB", "pfam": "Pfam"}


def domain_policy(evalue: Column, coverage: Column, mode: str = "GA", max_evalue: float | None = None,
                  min_coverage: float | None = None, trusted: bool = False) -> Column:
    """EV01: strength of a domain hit under gathering cut-offs, none, or manual limits."""
    if mode == "GA":
        return F.lit("STRONG")
    if mode == "NONE":
        return F.lit("WEAK")
    fails = F.lit(False)
    if max_evalue is not None:
        fails = fails | (evalue > max_evalue)
    if min_coverage is not None:
        fails = fails | coverage.isNull() | (coverage < min_coverage)
    passed = "STRONG" if trusted or (max_evalue is not None and min_coverage is not None) else "WEAK"
    return F.when(fails, "REJECTED").otherwise(passed)


def orthology_policy(evalue: Column, coverage: Column, max_evalue: float | None = 1e-5, min_coverage: float | None = 0.5) -> Column:
    """EV02: viral-orthology profile hits; without any limit a hit is only weak."""
    fails = F.lit(False)
    if max_evalue is not None:
        fails = fails | (evalue > max_evalue)
    if min_coverage is not None:
        fails = fails | coverage.isNull() | (coverage < min_coverage)
    return F.when(fails, "REJECTED").otherwise("WEAK" if max_evalue is None and min_coverage is None else "STRONG")


def homology_policy(identity: Column, qcov: Column, scov: Column, evalue: Column, aln_len: Column) -> Column:
    """EV03: curated sequence homology in two tiers."""
    both = lambda ident, cov: (identity >= ident) & (qcov >= cov) & (scov >= cov)
    return (
        F.when((evalue > 1e-5) | (aln_len < 30), "REJECTED")
        .when(both(0.70, 0.70), "STRONG").when(both(0.35, 0.40), "MODERATE").otherwise("REJECTED")
    )


def phage_orthology_policy(**limits: tuple[Column, float]) -> Column:
    """EV04: optional limits by name (evalue=(col, max), coverage/score/identity/aln_len=(col, min))."""
    fails = F.lit(False)
    for name, (column, limit) in limits.items():
        fails = fails | ((column > limit) if name == "evalue" else (column.isNull() | (column < limit)))
    return F.when(fails, "REJECTED").otherwise("STRONG" if limits else "MODERATE")


def known_function(description: Column) -> Column:
    """EV04: unknown functions carry no description."""
    return F.when(~F.lower(F.trim(description)).isin(*rules.UNKNOWN_LABELS), description)


def merge_backends(hits: DataFrame) -> DataFrame:
    """EV05: one row per (protein, identifier); a supporting hit beats an earlier rejected one.

    Columns: protein_id, identifier, backend, supports, seq (arrival order), description, bits.
    """
    order = F.struct((~F.col("supports")).alias("a"), F.col("seq"))
    return hits.groupBy("protein_id", "identifier").agg(
        F.min_by(F.struct("backend", "supports", "description", "bits"), order).alias("k"),
        F.array_join(F.array_sort(F.collect_set("backend")), ";").alias("search_backends"),
        (F.count("*") - 1).alias("corroborating_hits")).select(
        "protein_id", "identifier", F.col("k.backend").alias("backend"), F.col("k.supports").alias("supports"),
        F.col("k.description").alias("description"), F.col("k.bits").alias("bits"), "search_backends", "corroborating_hits")


def mark_conflicts(hits: DataFrame) -> DataFrame:
    """EV06: proteins with several descriptions from one source; minima and maxima replace sets."""
    counts = F.when(F.col("source") == "PHROGs", F.col("supports") & (F.col("strength") == "STRONG")).otherwise(F.col("supports"))
    named = hits.where(counts & F.col("description").isNotNull()).groupBy("protein_id", "source").agg(
        (F.min("description") != F.max("description")).alias("conflict"))
    return hits.join(named, ["protein_id", "source"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def family_support(hits: DataFrame) -> DataFrame:
    """EV07: orthology hits good enough to support a family claim."""
    return hits.where(F.col("source").isin("PHROGs", "VOGDB") & F.col("supports") & (F.col("evalue") <= 1e-5)
                      & F.col("query_coverage").between(0.70, 1.0) & F.col("identifier").isNotNull())


def text_markers(hits: DataFrame, text: Column) -> DataFrame:
    """EV08: evidence text that deserves a safety review, per category; silence is not safety."""
    anti = text.rlike(r"(?i)\banti[- ]?toxin\b") & ~text.rlike(r"(?i)\b(?:shiga|entero|exo|cyto)toxin\b")
    found = [F.when(text.rlike(p) & (~anti if c == "toxin_virulence" else F.lit(True)), F.lit(c)) for c, p in rules.SAFETY_PATTERNS.items()]
    return hits.withColumn("category", F.explode(F.array_compact(F.array(*found))))


def similarity_screen(hits: DataFrame, configured: list[str]) -> tuple[DataFrame, list[str]]:
    """EV09: database hits by category, and the categories nobody searched."""
    good = hits.where((F.col("pident") >= 40) & (F.least("qcov", "scov") >= 0.8) & (F.col("evalue") <= 1e-5) & F.col("category").isin(*configured))
    return good, sorted(set(rules.SAFETY_PATTERNS) - set(configured))


def representatives(proteins: DataFrame) -> DataFrame:
    """EV10: one protein per distinct sequence, the first by id; duplicates combine before the shuffle."""
    return proteins.groupBy("sha").agg(F.min("protein_id").alias("protein_id"), F.count("*").alias("occurrences"))


def copy_to_occurrences(hits: DataFrame, proteins: DataFrame) -> DataFrame:
    """EV10: hits of a distinct sequence (``sha``) repeated for every protein that has it.

    Copies of one sequence may be a third of all proteins: the large side keeps its own
    partitioning whenever the distinct hits are small, and the adaptive skew join splits it otherwise.
    """
    return proteins.select("sha", "protein_id", "genome_id").join(hits, "sha")


def missing_searches(proteins: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """EV11: distinct sequences without an intact cache entry for this search configuration."""
    known = cache.where((F.col("fingerprint") == fingerprint) & (F.col("digest") == cache_digest())).select("sha").distinct()
    return proteins.select("sha").distinct().join(known, "sha", "left_anti")


def cache_digest() -> Column:
    """EV11: integrity digest of a cache row."""
    return F.sha2(F.concat_ws("|", "fingerprint", "sha", F.coalesce("identifier", F.lit("")), F.coalesce(F.col("evalue").cast("string"), F.lit(""))), 256)


def updated_cache(cache: DataFrame, searched: DataFrame, new_hits: DataFrame, fingerprint: str) -> DataFrame:
    """EV11: append results of successful searches; a sequence without hits leaves an explicit row."""
    rows = searched.select("sha").distinct().join(new_hits.select("sha", "identifier", "evalue"), "sha", "left").withColumn("fingerprint", F.lit(fingerprint))
    return cache.unionByName(rows.withColumn("digest", cache_digest()).select(*cache.columns))


def fan_out(candidates: DataFrame, searches: DataFrame, hits: DataFrame) -> DataFrame:
    """EV12: status and hits of each distinct translation copied to every candidate model.

    searches: sha, adapter, state (EXECUTED, CACHED, UNAVAILABLE); hits: sha, adapter, identifier.
    """
    per = hits.groupBy("sha", "adapter").agg(F.count("*").alias("hits"))
    out = candidates.join(searches, "sha").join(per, ["sha", "adapter"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    status = (
        F.when(F.col("state") == "UNAVAILABLE", "RESOURCE_UNAVAILABLE").when(F.col("state") == "CACHED", "CACHE_REUSED")
        .when(F.col("hits") == 0, "SEARCH_EXECUTED_ZERO_HITS").otherwise("SEARCH_EXECUTED")
    )
    return out.select("model_id", "sha", "adapter", status.alias("evidence_status"), "hits")


def support_matrix(proteins: DataFrame, hits: DataFrame) -> DataFrame:
    """EV13: 0/1 per protein and source, proteins without evidence included."""
    has = lambda s: F.max(F.when(F.col("source") == s, 1).otherwise(0)).alias(s.lower().replace("-", ""))
    flags = hits.where("supports").groupBy("protein_id").agg(*[has(s) for s in ("Pfam", "VOGDB", "PHROGs", "Swiss-Prot")])
    return proteins.select("protein_id").join(flags, "protein_id", "left").fillna(0)


def external_import(models: DataFrame, external: DataFrame) -> DataFrame:
    """EV14: external annotations accepted only on a unique exact model with the same translation.

    models: genome_id, model_id, s, e, strand, protein; external: genome_id, external_id, s, e,
    strand, translation, product.
    """
    key = ["genome_id", "s", "e", "strand"]
    one = models.groupBy(*key).agg(F.count("*").alias("n"), F.min("model_id").alias("model_id"), F.min("protein").alias("protein"))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\*+$", "")
    out = external.join(one, key, "left")
    same = (F.col("n") == 1) & (bare(F.col("translation")) != "") & (bare(F.col("translation")) == bare(F.col("protein")))
    known = ~F.lower(F.trim(F.coalesce("product", F.lit("")))).isin("", "hypothetical protein", "unknown function", "uncharacterized protein", "uncharacterised protein")
    outcome = F.when(F.coalesce(same, F.lit(False)), F.when(known, "ACCEPTED").otherwise("SKIPPED_UNKNOWN_PRODUCT")).otherwise("NO_UNIQUE_EXACT_MATCH")
    return out.select("genome_id", "external_id", F.when(same, F.col("model_id")).alias("model_id"), "product", outcome.alias("outcome"))


def cross_group_review(hits: DataFrame) -> DataFrame:
    """EV15: queries resembling proteins of several domains of life at low identity."""
    domain = lambda g: F.max((F.col("source_group") == g).cast("int"))
    return hits.groupBy("query").agg(
        F.count("*").alias("hit_count"), F.array_join(F.array_sort(F.collect_set("source_group")), ";").alias("source_groups"),
        F.array_join(F.array_sort(F.collect_set("method")), ";").alias("methods"),
        F.when((domain("phage") + domain("bacteria") + domain("eukaryote") >= 2) & F.bool_or(F.col("sequence_identity") < 0.25), "manual_review")
        .otherwise("background").alias("review_priority"))


def top_hits(hits: DataFrame, sources: dict[str, str]) -> DataFrame:
    """EV16: best hit per source (smallest E-value, then ``hit_id``) as columns; one shuffle for all."""
    order = F.struct("evalue", "hit_id")
    row = F.struct("identifier", "description", "evalue", "query_coverage", "identity")
    picks = [F.min_by(F.when(F.col("source") == s, row), F.when(F.col("source") == s, order)).alias(n) for s, n in sources.items()]
    wide = hits.groupBy("protein_id").agg(*picks)
    cols = ["protein_id"]
    for n in sources.values():
        same = F.col(f"{n}.description") == F.col(f"{n}.identifier")
        label = F.when(F.col(f"{n}.description").isNull() | same, F.col(f"{n}.identifier")).otherwise(F.concat_ws(" - ", f"{n}.identifier", f"{n}.description"))
        cols += [label.alias(f"{n}_hit"), F.col(f"{n}.evalue").alias(f"{n}_evalue"), F.col(f"{n}.query_coverage").alias(f"{n}_coverage"), F.col(f"{n}.identity").alias(f"{n}_identity")]
    return wide.select(*cols)


def deduplicate(*fragments: DataFrame) -> DataFrame:
    """EV17: union of search fragments; only records equal in every field collapse."""
    out = fragments[0]
    for part in fragments[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates()


def canonical_source(source: Column) -> Column:
    """EV17: one spelling per source, for counting only."""
    return F.coalesce(literal_map(SOURCE_SPELLINGS)[F.lower(source)], source)


def outcome_summary(status: DataFrame, hits: DataFrame) -> DataFrame:
    """EV18: per source, unavailable is never reported as zero hits."""
    agg = hits.where("supports").groupBy("source").agg(F.count("*").alias("accepted_hits"), F.count_distinct("protein_id").alias("proteins"))
    out = status.join(agg, "source", "left")
    ready = F.col("state") == "AVAILABLE"
    outcome = F.when(~ready, "UNAVAILABLE").when(F.coalesce("accepted_hits", F.lit(0)) > 0, "SUCCESS_WITH_HITS").otherwise("SUCCESS_NO_HIT")
    return out.select("source", outcome.alias("outcome"), F.when(ready, F.coalesce("accepted_hits", F.lit(0))).alias("accepted_hits"),
                      F.when(ready, F.coalesce("proteins", F.lit(0))).alias("proteins"))
