"""Evidence fusion (FU01-FU22): from accepted hits to one auditable decision per protein.

Hits flow through grouped minima, maxima and counts keyed by (protein, label, source), then
(protein, label), then protein.  Arrays only ever hold the distinct labels of a protein, so a
protein with very many hits costs map-side combining, not a large group.

Hit columns: protein_id, hit_id (arrival order), source, supports, strength, description,
identifier, evalue, identity, query_coverage, subject_coverage, bits, aln_len, query_length,
subject_length, organism, reviewed, gene, ec, entry_name, profile_coverage, category.  Missing
optional columns are read as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virocohort.functions.columns import contains_any, fraction, joined, literal_map
from virocohort.functions.labels import PROPHAGE, normalise_function
from virocohort.operators.matching import walk_groups
from virocohort.operators.ordering import ordinal, running_total, with_neighbours
from virocohort.rules import fusion as rules
from virocohort.session import cut_lineage

OPTIONAL = {
    "subject_coverage": "double", "aln_len": "double", "query_length": "double", "subject_length": "double", "organism": "string",
    "reviewed": "boolean", "gene": "string", "ec": "string", "entry_name": "string", "profile_coverage": "double", "category": "string",
}


def complete(hits: DataFrame) -> DataFrame:
    for name, kind in OPTIONAL.items():
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    return hits


def compatible(a: Column, b: Column) -> Column:
    return (a == b) | a.contains(b) | b.contains(a)


def vocabulary(hits: DataFrame) -> DataFrame:
    """Everything that follows from a description alone, once per distinct description.

    Search databases repeat few names over very many hits, so the pattern work is done on the names
    and joined back.
    """
    words = hits.where("supports").select("description").distinct().withColumn("label0", normalise_function(F.col("description")))
    label = F.col("label0")
    entry = F.regexp_extract(F.coalesce("description", F.lit("")), r"\bsp\|[^|]+\|([^\s]+)", 1)
    return words.select(
        F.col("description").alias("__name"), "label0", entry.alias("tagged"), F.regexp_replace(label, PROPHAGE, "").alias("symbol_label"), contains_any(label, rules.SAFE_TERMS).alias("safe"),
        contains_any(label, rules.TAXON_TERMS).alias("taxon"), label.contains("bcs1").alias("bcs1"), (label.contains("band 7") | label.contains("spfh")).alias("band7"),
        (label.rlike(r"\bopg\d+\b") | label.contains("immune evasion protein opg")).alias("opg"), contains_any(label, ("mitochondrial", "chloroplastic", "chloroplast")).alias("organelle"),
        F.coalesce(contains_any(label, ("aaa", "atpase")), F.lit(False)).alias("w_atpase"), F.coalesce(contains_any(label, ("kelch", "beta-propeller")), F.lit(False)).alias("w_kelch"))


def labelled_hits(hits: DataFrame) -> DataFrame:
    """Supporting hits with the facts of their description."""
    acc = complete(hits).where("supports")
    return acc.join(vocabulary(hits), acc["description"].eqNullSafe(F.col("__name")), "left").drop("__name")


def accepted_hits(hits: DataFrame) -> DataFrame:
    """Supporting hits with their normalised function and distinct-label context (FU02, FU03 inputs)."""
    acc = labelled_hits(hits)
    peers = F.collect_set(F.when((F.col("source") != "Pfam") & F.col("label0").isNotNull(), F.struct("source", F.col("label0").alias("label"))))
    context = acc.groupBy("protein_id").agg(peers.alias("peers"), F.bool_or("w_atpase").alias("says_atpase"), F.bool_or("w_kelch").alias("says_kelch"))
    return acc.join(context, "protein_id")


def corroborated() -> Column:
    """FU02: another accepted non-domain source says the same or a narrower or wider name."""
    return F.exists("peers", lambda p: (p["source"] != F.col("source")) & compatible(p["label"], F.col("label0")))


def conservative() -> tuple[Column, Column]:
    """FU03: (label, flag) after removing taxon-, organelle- and locus-specific claims."""
    label = F.col("label0")
    bcs1, band7, opg, organelle = F.col("bcs1") & F.col("says_atpase"), F.col("band7"), F.col("opg"), F.col("organelle")
    return (
        F.when(bcs1, "bcs1-like aaa-family atpase").when(band7, "band 7/spfh family protein")
        .when(opg, F.when(F.col("says_kelch"), "kelch-repeat beta-propeller protein")).when(organelle, F.lit(None)).otherwise(label),
        F.when(bcs1, rules.FLAG_BCS1).when(band7, rules.FLAG_BAND7)
        .when(opg, F.when(F.col("says_kelch"), rules.FLAG_KELCH).otherwise(rules.FLAG_OPG)).when(organelle, rules.FLAG_ORGANELLE),
    )


def anchors() -> tuple[Column, Column]:
    """FU04: curated phage anchor and full-length identical anchor of one hit."""
    organism = F.lower(F.coalesce("organism", F.lit("")))
    ident, qcov, scov = (fraction(F.col(c)) for c in ("identity", "query_coverage", "subject_coverage"))
    base = (F.col("source") == "Swiss-Prot") & F.coalesce("reviewed", F.lit(False)) & organism.contains("phage") & (F.col("evalue") <= 1e-20)
    near = ((ident >= 0.40) & (qcov >= 0.80) & (scov >= 0.80)) | ((ident >= 0.35) & (qcov >= 0.90) & (scov >= 0.90))
    curated = F.coalesce(base & near, F.lit(False))
    full = curated & F.coalesce(
        (ident == 1.0) & (F.col("query_length") > 0) & (F.col("query_length") == F.col("subject_length")) & (F.col("subject_length") == F.col("aln_len"))
        & (F.col("query_coverage") == 1.0) & (F.col("subject_coverage") == 1.0), F.lit(False))
    return curated, full


def candidate_score(safe: Column) -> Column:
    """FU05: rank product hypotheses by provenance and alignment (``safe``: a phage-compatible name)."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.coalesce(c, F.lit(0.0)), F.lit(1.0)))
    return (
        F.coalesce(literal_map(rules.SOURCE_WEIGHT)[F.col("source")], F.lit(10.0))
        + F.coalesce(literal_map(rules.STRENGTH_WEIGHT)[F.col("strength")], F.lit(0.0))
        + 20.0 * clip(fraction(F.col("identity"))) + 15.0 * clip(fraction(F.col("query_coverage")))
        + F.least(F.greatest(F.coalesce("bits", F.lit(0.0)), F.lit(0.0)) / 50.0, F.lit(12.0))
        + F.when(F.col("evalue") <= 1e-20, 8.0).otherwise(0.0) + F.when(safe, 8.0).otherwise(0.0)
    )


def product_candidates(accepted: DataFrame) -> DataFrame:
    """FU01: the product name each accepted hit may propose, or the flag that withholds it."""
    label = F.col("label0")
    symbol_label = F.col("symbol_label")
    gene = F.lower(F.trim(F.coalesce("gene", F.lit(""))))
    entry = F.when(F.coalesce("entry_name", F.lit("")) != "", F.col("entry_name")).otherwise(F.col("tagged"))
    record = F.when(entry.contains("_"), F.lower(F.substring_index(entry, "_", 1))).otherwise("")
    role = record.endswith("ase") | record.isin(*rules.ROLE_WORDS)
    symbol_only = (gene != "") & ((symbol_label == F.concat(F.lit("protein "), gene)) | (symbol_label == F.concat(gene, F.lit(" protein"))))
    entry_only = (record != "") & (symbol_label == F.concat(F.lit("protein "), record)) & ~role
    partial = F.col("source").isin("PHROGs", "VOGDB") & (fraction(F.coalesce("profile_coverage", "subject_coverage")) < 0.5)
    safe = F.col("safe")
    backed = F.col("backed")
    phage_record = F.lower(F.coalesce("organism", F.lit(""))).contains("phage")
    plain, plain_flag = conservative()
    rewritten = F.coalesce(plain != label, F.lit(False))
    vog = (F.col("source") == "VOGDB") & ~(safe | backed)
    swiss = (F.col("source") == "Swiss-Prot") & ~(phage_record | safe | backed)
    taxon = F.col("taxon")
    no = F.lit(False)
    ladder = [
        (label.isNull(), None, None), (symbol_only, None, rules.FLAG_SYMBOL), (entry_only, None, rules.FLAG_ENTRY),
        (F.col("source") == "Pfam", None, rules.FLAG_DOMAIN), (F.coalesce(partial, no), None, rules.FLAG_PARTIAL),
        (rewritten, plain, plain_flag), (taxon, None, rules.FLAG_TAXON), (vog, None, rules.FLAG_VOG), (swiss, None, rules.FLAG_SWISS),
    ]
    name, flag = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for test, value, why in ladder:
        name = name.when(test, value if isinstance(value, Column) else F.lit(value).cast("string"))
        flag = flag.when(test, why if isinstance(why, Column) else F.lit(why).cast("string"))
    rows = accepted.withColumn("backed", corroborated()).withColumn("label", name.otherwise(plain)).withColumn("flag", flag.otherwise(plain_flag))
    curated, full = anchors()
    named_safe = F.when(F.col("label") == F.col("label0"), F.col("safe")).otherwise(contains_any(F.col("label"), rules.SAFE_TERMS))
    return rows.withColumn("curated", curated).withColumn("full_identity", full).withColumn("score", F.when(F.col("label").isNotNull(), candidate_score(named_safe)))


def _order() -> Column:
    """Best first: higher score, then label, then arrival."""
    return F.struct((-F.col("score")).alias("a"), F.col("label").alias("b"), F.col("hit_id").alias("c"))


def gather(candidates: DataFrame) -> DataFrame:
    """One row per protein with its proposed labels, domain notes and evidence facts.

    All of it comes from one grouping by (protein, source, name), where the name is the proposed label
    or, for domain hits, the neutral note; two small groupings follow.
    """
    name = F.when(F.col("source") == "Pfam", domain_note()).otherwise(F.col("label"))
    strong, pfam, orthology = F.col("strength") == "STRONG", F.col("source") == "Pfam", F.col("source").isin("PHROGs", "VOGDB")
    label0 = F.col("label0")
    says = lambda test, *terms: F.coalesce(test & contains_any(label0, terms), F.lit(False))
    category = F.when(~F.lower(F.trim(F.coalesce("category", F.lit("")))).isin(*rules.UNKNOWN_LABELS, "xu", "unknown"), F.trim("category"))
    own = (F.col("label") == label0) & F.col("strength").isin("STRONG", "EXPERIMENTAL") & F.col("gene").rlike(r"^[A-Za-z][A-Za-z0-9_.-]{0,19}$")
    rank = F.struct((-F.coalesce(literal_map(rules.STRENGTH_RANK)[F.col("strength")], F.lit(0))).alias("a"), (-F.coalesce(literal_map(rules.SOURCE_RANK)[F.col("source")], F.lit(0))).alias("b"),
                    F.coalesce("identifier", F.lit("")).alias("c"), F.col("hit_id"), F.concat_ws(":", "source", F.coalesce("identifier", F.lit("match"))).alias("text"))
    flags = {
        "experimental": F.col("strength") == "EXPERIMENTAL", "has_domain": pfam, "conserved": orthology, "strongly": orthology & strong,
        "d_pol": says(pfam, "dna polymerase family a"), "d_ssb": says(pfam, "enterobacter phage enc34, ssdna-binding protein", "single-stranded dna-binding"), "d_vrr": says(pfam, "vrr-nuc"),
        "d_hjr": says(F.col("source") == "PHROGs", "holliday junction resolvase"), "d_hth": says(pfam, "helix-turn-helix"),
        "d_exc": F.coalesce((F.col("source") == "PHROGs") & label0.contains("excisionase") & label0.contains("transcriptional regulator"), F.lit(False)),
        "d_cat": F.coalesce(F.lower(category).contains("integration and excision"), F.lit(False)), "d_reg": says(F.lit(True), "transcriptional regulator"),
    }
    sets = {"categories": category, "ortholog_groups": F.when(orthology, F.col("identifier")), "flags": F.col("flag")}
    either = lambda names: [F.bool_or(n).alias(n) for n in names]
    merged = lambda names: [F.array_distinct(F.flatten(F.collect_list(n))).alias(n) for n in names]
    per_source = candidates.withColumn("name", name).groupBy("protein_id", "source", "name").agg(
        F.count("*").alias("n"), F.min(_order()).alias("o"), F.min("hit_id").alias("first_hit"), F.bool_or(strong & F.col("label").isNotNull()).alias("strong"), F.max(F.when(strong, F.col("score"))).alias("strong_score"),
        F.min_by(fraction(F.col("query_coverage")), F.when(strong, _order())).alias("strong_cov"), F.max(F.when(F.col("curated"), F.col("score"))).alias("curated_score"),
        F.max(F.when(F.col("full_identity"), F.col("score"))).alias("full_score"), F.bool_or(F.coalesce((F.col("label") != label0) & F.col("flag").isNotNull(), F.lit(False))).alias("rewrite"),
        F.min(F.when(own, F.col("gene"))).alias("g0"), F.max(F.when(own, F.col("gene"))).alias("g1"), F.min(rank).alias("best"),
        *[F.bool_or(v).alias(k) for k, v in flags.items()], *[F.collect_set(v).alias(k) for k, v in sets.items()])
    domain = F.col("source") == "Pfam"
    per_name = per_source.groupBy("protein_id", domain.alias("domain"), "name").agg(
        F.sum("n").alias("records"), F.min("o").alias("o"), F.min("first_hit").alias("first_hit"), F.count("*").alias("sources"), F.count_if("strong").alias("strong_sources"), F.max("strong_score").alias("strong_score"),
        F.max(F.when(F.col("strong"), F.col("strong_cov"))).alias("strong_cov"), F.max("curated_score").alias("curated_score"), F.max("full_score").alias("full_score"), F.bool_or("rewrite").alias("rewrite"),
        F.bool_or(F.col("strong") & (F.col("source") == "Swiss-Prot")).alias("swiss_strong"), F.array_sort(F.collect_set("source")).alias("source_names"),
        F.array_sort(F.collect_set(F.when(F.col("strong"), F.col("source")))).alias("strong_names"), F.min("g0").alias("g0"), F.max("g1").alias("g1"), F.min("best").alias("best"), *either(flags), *merged(sets))
    named = F.col("name").isNotNull()
    entry = F.struct(
        F.col("o.a").alias("neg_score"), F.col("name").alias("label"), F.col("o.c").alias("hit_id"), "records", "sources", "strong_sources", "strong_score", "strong_cov",
        "curated_score", "full_score", "rewrite", "swiss_strong", "source_names", "strong_names", "g0", "g1")
    return per_name.groupBy("protein_id").agg(
        F.array_sort(F.collect_list(F.when(named & ~F.col("domain"), entry))).alias("ls"), F.array_sort(F.collect_list(F.when(named & F.col("domain"), F.struct("first_hit", "name")))).alias("notes"),
        F.sum("records").alias("accepted_records"), F.array_distinct(F.flatten(F.collect_list("source_names"))).alias("supporting_sources"), F.min("best").alias("best"), *either(flags), *merged(sets))


def select_products(gathered: DataFrame) -> DataFrame:
    """FU06: one product per protein or an abstention, added to the gathered row."""
    t = gathered
    has_full = F.exists("ls", lambda x: x["full_score"].isNotNull())
    t = t.withColumn("pool", F.filter("ls", lambda x: F.when(has_full, x["full_score"]).otherwise(x["curated_score"]).isNotNull()))
    aggregate = lambda x: x["strong_score"] + 4.0 * (x["strong_sources"] - 1)
    voted = F.filter("ls", lambda x: (x["strong_sources"] >= 2) & (x["strong_cov"] >= 0.8))
    ranked = F.array_sort(F.transform(voted, lambda x: F.struct((-x["strong_sources"]).alias("n"), (-aggregate(x)).alias("s"), x["label"].alias("label"))))
    t = t.withColumn("votes", ranked).withColumn("top", F.get("ls", F.lit(0)))
    v1, v2 = F.get("votes", F.lit(0)), F.get("votes", F.lit(1))
    consensus = F.when(v1.isNotNull() & (v2.isNull() | (v1["n"] < v2["n"]) | (v2["s"] - v1["s"] >= rules.SCORE_MARGIN)), v1["label"])
    wanted = literal_map(rules.PREFERRED_SPECIFIC)[F.col("top.label")]
    specific = F.when(F.exists("ls", lambda x: x["label"] == wanted), wanted)
    others = F.filter("ls", lambda x: x["label"] != F.col("top.label"))
    runner = F.array_max(F.transform(others, lambda x: -x["neg_score"]))
    fits = F.forall(others, lambda x: compatible(x["label"], F.col("top.label")))
    lead = F.when(fits | (-F.col("top.neg_score") - runner >= rules.SCORE_MARGIN), F.col("top.label"))
    pooled = F.size("pool")
    how = (
        F.when(pooled > 1, "CURATED_DISAGREEMENT").when(pooled == 1, "CURATED_ANCHOR").when(consensus.isNotNull(), "CONSENSUS")
        .when(specific.isNotNull(), "SPECIFIC_TERM").when(lead.isNotNull(), "TOP_RANKED").otherwise("ABSTAINED")
    )
    product = F.when(pooled == 1, F.get("pool", F.lit(0))["label"]).when(pooled == 0, F.coalesce(consensus, specific, lead))
    text = F.array_join(F.transform("ls", lambda x: F.concat(x["label"], F.lit("="), F.format_number(-x["neg_score"], 3))), "; ")
    return t.select(*gathered.columns, product.alias("product"), F.when(F.size("ls") > 0, how).alias("basis"), (pooled > 1).alias("curated_disagreement"),
                    has_full.alias("full_identity"), text.alias("alternatives"))


def protein_facts(gathered: DataFrame) -> DataFrame:
    """FU07, FU09, FU10: diagnostic product, domain summary and conservation of each protein."""
    diagnostic = (
        F.when(F.col("d_pol"), "family-a dna polymerase").when(F.col("d_ssb"), "single-stranded dna-binding protein")
        .when(F.col("d_vrr") & F.col("d_hjr"), "holliday junction resolvase")
        .when(F.col("d_hth") & F.col("d_exc") & F.col("d_cat"), "excisionase and transcriptional regulator")
        .when(F.col("d_hth") & F.col("d_reg"), "helix-turn-helix transcriptional regulator")
    )
    kept = F.when(F.col("strongly"), "STRONGLY_CONSERVED").when(F.col("conserved"), "CONSERVED").otherwise("NOT_ESTABLISHED")
    out = gathered.withColumn("diagnostic_product", diagnostic).withColumn("conservation_status", kept).withColumn("notes", F.transform("notes", lambda x: x["name"]))
    for lead, first, dropped in (("ninh", "ninh-like domain", ("transposase", "ninh")), ("atpase-related domain", "atpase-related domain", ("p-type atpase actuator", "atpase-related domain"))):
        rest = F.concat(F.array(F.lit(first)), F.filter("notes", _without(dropped)))
        out = out.withColumn("notes", F.when(F.exists("notes", _mentions(lead)), rest).otherwise(F.col("notes")))
    summary = F.concat(F.lit("Detected domain evidence: "), F.array_join(F.slice("notes", 1, 2), " and "))
    return out.withColumn("domain_summary", F.when(F.size("notes") > 0, summary)).drop("notes")


def diagnostic_reason(product: Column) -> Column:
    """FU07: the reviewed rule behind a diagnostic product."""
    return literal_map(rules.DIAGNOSTIC_REASONS)[product]


def domain_note() -> Column:
    """FU09: the neutral note a domain hit may leave, never a product."""
    label = F.col("label0")
    return (
        F.when(label.contains("phage ninh protein and transposase"), "ninh-like domain")
        .when(label.contains("enterobacter phage enc34, ssdna-binding protein"), "single-stranded dna-binding domain")
        .when(label.contains("disarm protein drme"), "atpase-related domain")
        .when(F.col("taxon"), F.concat(F.lit("domain "), F.coalesce("identifier", F.lit("protein domain"))))
        .otherwise(label)
    )


def _without(terms):
    return lambda note: ~contains_any(note, terms)


def _mentions(term):
    return lambda note: note.contains(term)


def classify(hits: DataFrame) -> DataFrame:
    """FU06-FU12: the full decision per protein that has accepted evidence."""
    d = select_products(protein_facts(gather(product_candidates(accepted_hits(hits)))))
    no = F.lit(False)
    d = d.withColumn("disagree", F.coalesce("curated_disagreement", no)).withColumn("anchored", F.coalesce(F.col("basis") == "CURATED_ANCHOR", no))
    strong = F.filter("ls", lambda x: x["strong_sources"] > 0)
    d = d.withColumn("strong", strong).withColumn("strong_labels", F.transform("strong", lambda x: x["label"]))
    d = d.withColumn("strong_names", F.array_distinct(F.flatten(F.transform("strong", lambda x: x["strong_names"]))))
    agree = F.forall("strong_labels", lambda a: F.forall("strong_labels", lambda b: compatible(a, b)))
    groups = [F.exists("strong_labels", _any_of(g)).cast("int") for g in rules.INCOMPATIBLE_GROUPS]
    several = F.size("strong_labels") > 1
    d = d.withColumn("incompatible", sum(groups[1:], groups[0]) >= 2)
    full = F.coalesce("full_identity", no) & F.col("anchored")
    d = d.withColumn("full", full & ~F.col("disagree"))
    clash = (several & (F.size("strong_names") > 1) & F.col("incompatible")) | F.col("disagree")
    d = d.withColumn("clash", clash & ~F.col("full")).withColumn("unclear", several & ~agree & ~F.col("incompatible"))
    d = d.withColumn("diagnostic", F.when(~F.col("anchored") & ~F.col("disagree"), F.col("diagnostic_product")))
    rewrites = F.transform(F.filter("ls", lambda x: x["rewrite"]), lambda x: x["label"])
    base = F.coalesce("diagnostic", F.when(~F.col("clash"), F.col("product")))
    d = d.withColumn("final", F.when((F.size(rewrites) == 1) & ~F.col("anchored") & ~F.col("disagree"), F.get(rewrites, F.lit(0))).otherwise(base))
    d = d.withColumn("ambiguity", joined(
        F.when(F.size("flags") > 0, F.array_join(F.array_sort("flags"), "; ")),
        F.when(F.col("unclear"), "distinct strong labels could not be confidently established as biologically incompatible"),
        F.when(F.col("disagree"), "reviewed whole-protein records disagree; product specificity remains unresolved"),
        F.when(F.col("full"), "full-length 100%-identity reviewed alignment preferred; other labels retained as alternatives"),
        diagnostic_reason(F.col("diagnostic")), sep="; "))
    mine = F.get(F.filter("ls", lambda x: x["label"] == F.col("final")), F.lit(0))
    d = d.withColumn("mine", mine).withColumn("agreeing", F.coalesce(F.size(F.col("mine.source_names")), F.lit(0)))
    d = d.withColumn("agreeing", F.when(F.col("agreeing") < 0, 0).otherwise(F.col("agreeing")))
    families = F.array_distinct(F.transform("strong_names", lambda s: F.coalesce(literal_map(rules.MODALITY)[s], s)))
    orthology_only = F.forall(families, lambda m: m.isin("PHAGE_ORTHOLOGY", "VIRAL_ORTHOLOGY"))
    swiss = F.exists("strong", lambda x: x["swiss_strong"])
    independent = F.size("strong_names") >= 2
    known = (several | (F.size("strong_labels") == 1)) & (independent | (swiss & (F.col("agreeing") >= 2))) & (F.size(families) >= 2) & ~orthology_only & (F.col("ambiguity") == "")
    conserved = F.col("conservation_status") != "NOT_ESTABLISHED"
    state = (
        F.when(F.col("clash") & F.col("diagnostic").isNull(), "CONFLICTING_EVIDENCE").when(known, "KNOWN_FUNCTION").when(F.col("final").isNotNull(), "PROBABLE_FUNCTION")
        .when((F.size("categories") > 0) | F.col("has_domain"), "FUNCTIONAL_CLASS_ONLY").when(conserved, "CONSERVED_UNKNOWN").otherwise("UNRESOLVED")
    )
    d = d.withColumn("functional_state", state)
    low = F.coalesce(F.col("diagnostic").isin("single-stranded dna-binding protein", "helix-turn-helix transcriptional regulator"), no)
    confidence = (
        F.when(F.col("functional_state") == "KNOWN_FUNCTION", "HIGH")
        .when(F.col("functional_state") == "PROBABLE_FUNCTION", F.when(low, "LOW").when((F.size("strong_labels") > 0) | F.col("diagnostic").isNotNull(), "MODERATE").otherwise("LOW"))
        .when(F.col("functional_state") == "UNRESOLVED", "NONE").otherwise("LOW")
    )
    tier = (
        F.when(F.col("experimental") & F.col("final").isNotNull(), 1).when(F.col("functional_state") == "KNOWN_FUNCTION", 2)
        .when((F.col("functional_state") == "PROBABLE_FUNCTION") & (F.col("agreeing") >= 2), 3)
        .when(F.col("functional_state").isin("PROBABLE_FUNCTION", "FUNCTIONAL_CLASS_ONLY"), 4).when(F.col("functional_state") == "CONSERVED_UNKNOWN", 5).otherwise(6)
    )
    display = F.coalesce("final", F.when(conserved, "conserved phage protein of unknown function").otherwise("hypothetical protein"))
    gene = F.when(F.col("mine.g0") == F.col("mine.g1"), F.col("mine.g0"))
    return d.select(
        "protein_id", "functional_state", confidence.alias("confidence"), F.col("final").alias("proposed_function"), display.alias("display_product"),
        F.when(F.col("final").isNotNull(), gene).alias("gene"), tier.alias("evidence_tier"), F.col("best.text").alias("best_evidence"),
        F.when(F.col("functional_state").isin("CONFLICTING_EVIDENCE", "UNRESOLVED") | F.col("unclear"), "REVIEW_REQUIRED").otherwise("NONE").alias("review_flag"),
        F.coalesce("basis", F.lit("NO_CANDIDATE")).alias("selection_basis"), "diagnostic_product", "domain_summary", F.array_join(F.array_sort("categories"), "; ").alias("functional_category"),
        "conservation_status", F.array_join(F.array_sort("supporting_sources"), ";").alias("supporting_sources"), F.col("agreeing").alias("product_supporting_source_count"),
        F.coalesce("mine.records", F.lit(0)).alias("product_supporting_record_count"), F.col("clash").alias("conflict"),
        F.array_join(F.array_sort("ortholog_groups"), ";").alias("ortholog_groups"), F.coalesce("alternatives", F.lit("")).alias("alternatives"), F.col("ambiguity").alias("ambiguity_flags"))


def _any_of(group):
    return lambda label: contains_any(label, group)


def upgrade_tail_neighbours(classified: DataFrame, reach: int = 2) -> DataFrame:
    """FU13: unnamed conserved genes among tail genes become putative tail proteins, in gene order.

    An upgraded gene can anchor the next one, so candidates are walked in order - but only within
    chains of candidates at most ``reach`` genes apart, which is as far as one can act on another.
    Input: genome_id, protein_id, s, e, proposed_function, functional_category, functional_state,
    conservation_status, domain_summary, alternatives.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("proposed_function", F.lit("")), F.coalesce("functional_category", F.lit(""))))
    rows = ordinal(classified.withColumn("tail", contains_any(text, rules.TAIL_TERMS)), ["genome_id"], "s", ["s", "e", "protein_id"])
    seen = lambda at, f: F.coalesce(at.over(f.ordered), F.lit(False))
    near = lambda f: {"tm2": seen(F.lag("tail", 2), f), "tm1": seen(F.lag("tail", 1), f), "t1": seen(F.lead("tail", 1), f), "t2": seen(F.lead("tail", 2), f)}
    rows = with_neighbours(rows, ["genome_id"], "idx", reach, near)
    open_ = F.col("proposed_function").isNull() & F.col("conservation_status").isin("CONSERVED", "STRONGLY_CONSERVED")
    minor = F.coalesce(F.concat(F.lit("; "), F.col("alternatives")).contains("; minor tail protein="), F.lit(False))
    domain = contains_any(F.lower(F.coalesce("domain_summary", F.lit(""))), ("tail tube", "tail protein", "mbg domain"))
    product = F.when(minor, "putative minor tail protein").when(domain | (F.col("functional_state") == "CONSERVED_UNKNOWN"), "putative tail-associated protein")
    cands = cut_lineage(rows.withColumn("new_product", product).where(open_ & F.col("new_product").isNotNull()).select(
        "genome_id", "protein_id", "idx", "new_product", "tm2", "tm1", "t1", "t2"))  # numbered and chained below
    step = with_neighbours(ordinal(cands, ["genome_id"], "idx", ["idx"], "k", 4096), ["genome_id"], "k", 1, lambda f: {"prev": F.lag("idx").over(f.ordered)})
    chained = running_total(step, ["genome_id"], "idx", ["idx"], F.when(F.col("idx") - F.col("prev") <= reach, 0).otherwise(1), "chain", 4096)

    def walk(chain: list) -> list[tuple]:
        up: set[int] = set()
        keep = []
        for row in chain:
            if bool(row.tm2 or row.idx - 2 in up) + bool(row.tm1 or row.idx - 1 in up) + row.t1 + row.t2 >= 2:
                up.add(row.idx)
                keep.append((row.genome_id, row.protein_id, row.new_product))
        return keep

    raised = walk_groups(chained, ["genome_id", "chain"], ["idx"], walk, "genome_id string, protein_id string, new_product string")
    out = classified.join(raised, ["genome_id", "protein_id"], "left")
    up = F.col("new_product").isNotNull()
    return out.withColumn("proposed_function", F.coalesce("new_product", "proposed_function")).withColumn(
        "functional_state", F.when(up, "PROBABLE_FUNCTION").otherwise(F.col("functional_state"))).withColumn("context_upgraded", up).drop("new_product")


def attach_gene_calls(classified: DataFrame, assessments: DataFrame) -> DataFrame:
    """FU14: caller confidence beside functional review, never mixed into it."""
    a = assessments.select("protein_id", F.col("gene_call_confidence").alias("c"), F.col("review_flag").alias("f"))
    out = classified.join(a, "protein_id", "left")
    return out.select(*classified.columns, F.coalesce("review_flag", F.lit("NONE")).alias("functional_review_flag"),
                      F.coalesce("c", F.lit("NOT_ASSESSED")).alias("gene_call_confidence"), F.coalesce("f", F.lit("NOT_ASSESSED")).alias("gene_call_review_flag"))


def adjudicate_function(evidence: DataFrame, loci: DataFrame) -> DataFrame:
    """FU15: seven-class functional verdict per locus (loci: locus_id, product, structural_confidence).

    evidence: locus_id, status, strength, evidence_type, role.
    """
    rejected = F.col("status").isin("REJECTED", "UNACCEPTED")
    conflicting = ~rejected & (F.col("status").isin("CONFLICTING", "CONFLICT") | F.coalesce(F.col("role").isin("CONFLICT", "CONFLICTING"), F.lit(False)))
    ok = ~rejected & ~conflicting & F.col("strength").isin(*rules.STRONG_STRENGTHS)
    weak = ~rejected & ~conflicting & ~F.col("strength").isin(*rules.STRONG_STRENGTHS)
    kind = F.lower("evidence_type")
    agg = evidence.groupBy("locus_id").agg(
        F.count_if(ok).alias("accepted"), F.count_if(weak).alias("weak"), F.count_if(rejected).alias("rejected"), F.count_if(conflicting).alias("conflicting"),
        F.bool_or(ok & (kind == "domain")).alias("domain"), F.bool_or(ok & kind.isin("sequence_similarity", "curated_homology", "experimental")).alias("whole"),
        F.bool_and(~ok | kind.isin("family", "orthology", "profile")).alias("family_only"))
    d = loci.join(agg, "locus_id", "left").fillna(0, ["accepted", "weak", "rejected", "conflicting"]).fillna(False, ["domain", "whole", "family_only"])
    unknown = F.coalesce("product", F.lit("")).rlike(r"(?i)\b(hypothetical|unknown|uncharacteri[sz]ed|unannotated|predicted protein)\b") | (F.coalesce("product", F.lit("")) == "")
    has = F.col("accepted") > 0
    cls = (
        F.when((F.col("conflicting") > 0) & ~has, "CONFLICTING").when(unknown, "HYPOTHETICAL").when(has & F.col("domain") & ~F.col("whole"), "DOMAIN_ONLY")
        .when(has & F.col("family_only"), "SUPPORTED_SPECIFIC").when(has & (F.col("structural_confidence") == "HIGH"), "HIGH_CONFIDENCE_SPECIFIC")
        .when(has, "SUPPORTED_SPECIFIC").when(F.col("weak") > 0, "SUPPORTED_GENERAL").otherwise("CONSERVED_UNKNOWN")
    )
    level = F.when(F.col("functional_class") == "HIGH_CONFIDENCE_SPECIFIC", "HIGH").when(F.col("functional_class") == "SUPPORTED_SPECIFIC", "MODERATE").otherwise("LOW")
    return d.withColumn("functional_class", cls).select("locus_id", "functional_class", level.alias("assignment_confidence"), "accepted", "weak", "rejected", "conflicting")


def adjudicate_structure(relationship: Column, records: Column, strong: Column, independent: Column) -> Column:
    """FU16: structural confidence from the caller relationship and independent support."""
    return (
        F.when(relationship == "EXACT_MATCH", "HIGH").when(strong & (independent | (records >= 2)), "MODERATE")
        .when((relationship == "PHANOTATE_ONLY") & (records == 0), "UNRESOLVED").otherwise("LOW")
    )


def module_evidence(evidence: DataFrame) -> DataFrame:
    """FU17: status of each module per genome; repeated hits of one database are one vote.

    evidence: genome_id, locus_id, label (upper case), role, strength, source.
    """
    hit = F.array_compact(F.array(*[F.when(contains_any(F.col("label"), {m, m.replace("_", " ")}), F.lit(m)) for m in rules.EVIDENCE_MODULES]))
    rows = evidence.withColumn("module", F.explode(hit))
    against = F.coalesce(F.col("role").isin("CONFLICT", "CONFLICTING"), F.lit(False))
    good = ~against & F.col("strength").isin(*rules.STRONG_STRENGTHS)
    agg = rows.groupBy("genome_id", "module").agg(
        F.count_if(good).alias("qualified_evidence_count"), F.count_if(~against).alias("evidence_count"), F.count_if(against).alias("conflicting_evidence_count"),
        F.count_distinct(F.when(good, F.col("source"))).alias("sources"))
    grid = evidence.select("genome_id").distinct().select("genome_id", F.explode(F.array(*map(F.lit, rules.EVIDENCE_MODULES))).alias("module"))
    out = grid.join(agg, ["genome_id", "module"], "left").fillna(0)
    status = (
        F.when((F.col("conflicting_evidence_count") > 0) & (F.col("qualified_evidence_count") == 0), "EVIDENCE_PRESENT_REVIEW_REQUIRED")
        .when(F.col("sources") >= 2, "STRONGLY_SUPPORTED").when(F.col("qualified_evidence_count") > 0, "SUPPORTED")
        .when(F.col("evidence_count") > 0, "CANDIDATE").otherwise("NOT_ESTABLISHED")
    )
    return out.select("genome_id", "module", status.alias("status"), "qualified_evidence_count", "evidence_count", "conflicting_evidence_count")


def architecture(modules: DataFrame) -> DataFrame:
    """FU18: architecture hypothesis per genome from module states; ties are mixed."""
    up = F.col("status").isin("ESTABLISHED", "STRONGLY_SUPPORTED", "SUPPORTED")
    has = lambda *names: F.bool_or(up & F.col("module").isin(*names))
    g = modules.groupBy("genome_id").agg(
        has("TAIL", "BASEPLATE", "PORTAL").alias("tailed"), F.count_if(up & F.col("module").isin(*rules.FILAMENTOUS_MODULES)).alias("fil"),
        (has("DNA_REPLICATION") & ~has("PORTAL") & ~has("TAIL")).alias("ss"),
        F.bool_or(F.col("status").isin("ESTABLISHED", "STRONGLY_SUPPORTED") & F.col("module").isin("TAIL", "PORTAL", "HEAD_CAPSID")).alias("tailed_strong"))
    t = F.when(F.col("tailed"), 2).otherwise(0)
    f = F.when(F.col("fil") >= 2, F.col("fil")).otherwise(0)
    s = F.when(F.col("ss"), 1).otherwise(0)
    top = F.greatest(t, f, s)
    ties = (t == top).cast("int") + (f == top).cast("int") + (s == top).cast("int")
    best = (
        F.when(top == 0, "ARCHITECTURE_UNRESOLVED").when(ties > 1, "MIXED_OR_CONFLICTING").when(F.col("tailed_strong") & (F.col("fil") >= 2), "MIXED_OR_CONFLICTING")
        .when(t == top, "TAILED_DSDNA_LIKE").when(f == top, "FILAMENTOUS_PHAGE_LIKE").otherwise("SMALL_SSDNA_PHAGE_LIKE")
    )
    return g.select("genome_id", best.alias("architecture"), t.cast("bigint").alias("tailed_score"), f.cast("bigint").alias("filamentous_score"), s.cast("bigint").alias("small_score"))


def architecture_hallmarks(arch: DataFrame, modules: DataFrame) -> DataFrame:
    """FU18: hallmark rows of the chosen architecture; what it cannot have is not applicable."""
    lists = F.create_map(*[x for k, v in rules.ARCHITECTURE_HALLMARKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = arch.select("genome_id", "architecture", F.explode(lists[F.col("architecture")]).alias("module")).join(modules.select("genome_id", "module", "status"), ["genome_id", "module"], "left")
    off = (F.col("architecture") == "FILAMENTOUS_PHAGE_LIKE") & F.col("module").isin(*rules.NOT_FILAMENTOUS)
    return rows.select("genome_id", "architecture", F.col("module").alias("hallmark"),
                       F.when(off, "NOT_APPLICABLE_TO_ARCHITECTURE").otherwise(F.coalesce("status", F.lit("NOT_ESTABLISHED"))).alias("status"))


def comparative_state(distance: Column, shared_hashes: Column, conservation: Column, sharing: Column, significant: Column, ready: Column) -> Column:
    """FU19: comparative significance; a nearest neighbour by distance alone proves nothing."""
    score = F.greatest(F.coalesce(conservation, F.lit(0.0)), F.coalesce(sharing, F.lit(0.0)))
    void = F.coalesce(~significant, F.lit(False)) | (F.coalesce((shared_hashes == 0) | (distance == 1.0), F.lit(False)) & ~F.coalesce(conservation >= 0.25, F.lit(False)))
    return (
        F.when(~ready, "DATABASE_UNAVAILABLE").when(void, "NO_SIGNIFICANT_REFERENCE")
        .when(significant.isNull() & conservation.isNull() & sharing.isNull(), "INSUFFICIENT_DATA")
        .when(score >= 0.7, "SIGNIFICANT_CLOSE_REFERENCE").when(score >= 0.25, "SIGNIFICANT_DISTANT_REFERENCE").otherwise("WEAK_REFERENCE")
    )


def cds_confidence(models: DataFrame, secondary: DataFrame, supported: DataFrame, strict: bool = False) -> DataFrame:
    """FU20: tier of each coding sequence from caller support at its stop, ribosome site and evidence.

    models: genome_id, model_id, s, e, strand, rbs_score, rescue; supported: model_id.
    """
    stop = F.when(F.col("strand") == "+", F.col("e")).otherwise(F.col("s"))
    stops = secondary.select("genome_id", "strand", stop.alias("stop"), F.lit(True).alias("second")).distinct()
    m = models.withColumn("stop", stop).join(stops, ["genome_id", "strand", "stop"], "left").join(supported.select("model_id", F.lit(True).alias("sup")).distinct(), "model_id", "left")
    both = ~F.col("rescue") & F.coalesce("second", F.lit(False))
    sup = F.coalesce("sup", F.lit(False))
    micro = ~F.col("rescue") & ~both & (F.col("e") - F.col("s") + 1 < 150)
    low = micro & (F.col("rbs_score") < 8) & ~sup
    return m.select(
        "genome_id", "model_id", F.when(low, "low").when(both | sup, "high").otherwise("medium").alias("confidence_tier"),
        F.when(F.col("rescue"), "Short-ORF-Rescue").when(both, "Both").otherwise("Primary").alias("caller_support"),
        micro.alias("single_caller_micro_orf"), (F.lit(strict) & low).alias("excluded"))


def interest_score(unknown: Column, domain_strong: Column, modalities: Column, length_aa: Column) -> tuple[Column, Column]:
    """FU21: discovery interest 0-100 and evidence diversity."""
    signal = F.when(unknown & domain_strong, 12).otherwise(0)
    convergence = F.when(unknown, F.least(F.lit(16), F.greatest(F.lit(0), modalities - 1) * 4)).otherwise(0)
    penalty = F.when(length_aa < 40, 15).otherwise(0)
    diversity = F.when(modalities >= 4, "High").when(modalities >= 2, "Moderate").when(modalities >= 1, "Low").otherwise("None")
    return F.greatest(F.lit(0), F.least(F.lit(100), signal + convergence - penalty)), diversity


def rank_candidates(proteins: DataFrame) -> DataFrame:
    """FU22: rank all candidates of each genome (genome_id, protein_id, interest, strong: has supporting strong evidence).

    Where no candidate of a genome has such evidence the ranks are null and the status says so.  Ranks are counted in
    bins of the score, so a genome with most candidates isn't one task.
    """
    ranked = ordinal(proteins.withColumn("__down", -F.col("interest")), ["genome_id"], "__down", ["__down", "protein_id"], "rank", 1)
    status = proteins.groupBy("genome_id").agg(F.when(F.bool_or("strong"), "RANKED").otherwise("INSUFFICIENT_EVIDENCE").alias("ranking_status"))
    return ranked.join(status, "genome_id").select(
        "genome_id", "protein_id", "interest", F.when(F.col("ranking_status") == "RANKED", F.col("rank") + 1).alias("rank"), "ranking_status")
