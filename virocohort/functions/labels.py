"""Product-label normalisation and predicates (TX01-TX10), as native regular-expression chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virocohort.functions.columns import contains_any, literal_map
from virocohort.rules import fusion as rules

# fixed patterns
IDENTIFIER_ONLY = (
    r"^(?:(?:protein|gene product)\s+(?:[a-z]|(?:gp|orf)?\d+(?:\.\d+)?[a-z]?|[a-z]+\d+[a-z0-9.-]*|[a-z0-9]+[-.][a-z0-9]+)"
    r"|(?:gp|orf)\s*\d+(?:\.\d+)?[a-z]?(?:\s+protein)?|gene\s+\d+(?:\.\d+)?[a-z]?\s+protein)$"
)
HEDGES = r"^(?:(?:putative|probable|predicted|conserved)\s+)+"
PROPHAGE = r"^(?:[a-z0-9.-]+\s+)?prophage-derived\s+"
UNNAMED = r"\b(hypothetical|uncharacterized|uncharacterised|unknown|unassigned)\b"
BARE_NAMES = ("protein", "conserved protein", "phage protein", "conserved phage protein")
UNRESOLVED_PREFIXES = ("hypothetical protein", "unknown protein", "uncharacterized protein", "uncharacterised protein", "protein of unknown function")
PRODUCT_ID = r"(?i)\b(?:[A-Z]{1,4}_?\d{4,}(?:\.\d+)?|(?:ORF|gp|PHROG|VOG|PF)[ _]?\d+(?:\.\d+)?[A-Za-z]?)\b"
VAGUE_PRODUCTS = ("", "putative phage protein", "phage protein", "putative protein", "protein", "putative", "gene product")
UNRESOLVED_NAMES = ("hypothetical protein", "conserved phage protein of unknown function", "unknown function", "uncharacterized protein")
PENDING = "UNRESOLVED_REVIEW_REQUIRED"
NOT_INFORMATIVE = r"(?i)\b(hypothetical|unknown|uncharacteri[sz]ed|unassigned|no annotation)\b"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def identifier_only(product: Column) -> Column:
    """TX02: locus or entry designations that describe no function."""
    text = F.lower(squeeze(F.coalesce(product, F.lit(""))))
    text = F.regexp_replace(F.regexp_replace(text, HEDGES, ""), PROPHAGE, "")
    return text.rlike(IDENTIFIER_ONLY)


def normalise_function(description: Column) -> Column:
    """TX01: comparable lower-case function text, null when nothing is known."""
    text = F.lower(squeeze(description))
    for pattern in rules.DATABASE_PREFIXES:
        text = F.regexp_replace(text, pattern, "")
    text = F.trim(text)
    unknown = text.rlike(rules.UNCHARACTERIZED) | text.rlike(rules.UNKNOWN_FUNCTION)
    named = F.coalesce(literal_map(rules.CANONICAL)[text], text)
    return F.when(~unknown & ~identifier_only(text) & ~named.isin(*rules.UNKNOWN_LABELS), named)


def normalise_product(product: Column) -> Column:
    """Comparison form: lower-case words and numbers only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(product, F.lit(""))), "[^a-z0-9]+", " "))


def informative_historical(product: Column) -> Column:
    """TX03: the frozen policy of earlier evaluations."""
    text = normalise_product(product)
    return (text != "") & ~text.rlike(UNNAMED) & ~text.isin(*BARE_NAMES)


def informative(product: Column) -> Column:
    """TX03: the current policy, which also drops identifiers and unknown families."""
    text = normalise_product(product)
    return informative_historical(product) & ~identifier_only(product) & ~text.isin("na", "n a", "nan", "none", "null") & ~text.rlike(r"\b(duf\d*|upf\d*)\b")


def sanitise_product(product: Column) -> Column:
    """TX04: submission-style name; vague or identifier-only names become ``hypothetical protein``."""
    text = squeeze(F.coalesce(product, F.lit("")))
    clean = F.regexp_replace(F.regexp_replace(text, r"\s*\{ECO:[^}]*\}", ""), PRODUCT_ID, "")
    clean = squeeze(F.regexp_replace(clean, r"\(\s*\)", ""))
    clean = F.regexp_replace(clean, r"^[ ,;:-]+|[ ,;:-]+$", "")
    clean = F.regexp_replace(clean, r"(?i)^probable\b", "putative")
    vague = (text == "") | text.rlike(r"(?i)\b(hypothetical|uncharacteri[sz]ed|unknown|unnamed)\b")
    symbol = clean.rlike(r"^(?:[a-z]{2,3}[A-Z][0-9]?|[A-Z][a-z]{2}[A-Z]?)$")
    return F.when(vague | symbol | F.lower(clean).isin(*VAGUE_PRODUCTS), "hypothetical protein").otherwise(clean)


def unresolved(label: Column) -> Column:
    """TX05: empty, or one of the unnamed labels alone or followed by more words."""
    text = F.lower(F.trim(label))
    hit = F.coalesce(text == "", F.lit(True))
    for name in UNRESOLVED_PREFIXES:
        hit = hit | (text == name) | text.startswith(name + " ")
    return hit


def relation_text(product: Column) -> Column:
    """Label form used to compare two products."""
    text = F.regexp_replace(F.lower(F.coalesce(product, F.lit(""))), rules.HEDGES, "")
    for pattern, plain in rules.COMPARED_AS:
        text = F.regexp_replace(text, pattern, plain)
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def product_relation(left: Column, right: Column) -> Column:
    """TX06: how two product names relate, without rewarding the longer one."""
    a, b = relation_text(left), relation_text(right)
    blank = lambda t: (t == "") | t.isin(*UNRESOLVED_NAMES)
    domain = lambda c: F.lower(F.coalesce(c, F.lit(""))).startswith("hypothetical protein containing ")
    ssb, gp25 = "single stranded dna binding protein", "gp2 5 like ssdna binding protein and ssdna annealing protein"
    return (
        F.when((a == b) & (a != ""), "EXACT_PRODUCT_AGREEMENT")
        .when(blank(a) & blank(b), "BOTH_FUNCTION_UNKNOWN")
        .when(domain(left) & blank(b), "LEFT_DOMAIN_INFORMATION_ONLY")
        .when(domain(right) & blank(a), "RIGHT_DOMAIN_INFORMATION_ONLY")
        .when(((a == ssb) & (b == gp25)) | ((a == gp25) & (b == ssb)), "EQUIVALENT_FUNCTION")
        .when(blank(a), "RIGHT_FUNCTIONALLY_MORE_INFORMATIVE")
        .when(blank(b), "LEFT_FUNCTIONALLY_MORE_INFORMATIVE")
        .otherwise("GENUINE_FUNCTIONAL_DISAGREEMENT")
    )


def synonym_pairs(table: DataFrame) -> DataFrame:
    """SC21: symmetric equivalences (rule_id, term_a, term_b, rationale) in comparison form."""
    a, b = normalise_product(F.col("term_a")), normalise_product(F.col("term_b"))
    one = table.select("rule_id", a.alias("a"), b.alias("b"))
    return one.unionByName(one.select("rule_id", F.col("b").alias("a"), F.col("a").alias("b")))


def synonym_problems(table: DataFrame) -> DataFrame:
    """SC21: rules that must be refused, with the reason."""
    a, b = normalise_product(F.col("term_a")), normalise_product(F.col("term_b"))
    t = table.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    twice = t.groupBy("lo", "hi").agg(F.count("*").alias("n"))
    t = t.join(twice, ["lo", "hi"])
    weak = ~informative_historical(F.col("lo")) | ~informative_historical(F.col("hi")) | (F.trim(F.coalesce("rationale", F.lit(""))) == "")
    reason = F.when(weak, "UNINFORMATIVE_TERM_OR_NO_RATIONALE").when((F.col("lo") == F.col("hi")) | (F.col("n") > 1), "DUPLICATE_OR_IDENTICAL_RULE")
    return t.select("rule_id", reason.alias("reason")).where("reason is not null")


def concordance(df: DataFrame, prediction: str, reference: str, synonyms: DataFrame, current: bool = True, name: str = "category") -> DataFrame:
    """TX07: category of a named prediction against a named reference.

    The synonym table is a curated rule file; the optimiser broadcasts it when it is small.
    """
    ok = informative if current else informative_historical
    df = df.withColumn("__a", normalise_product(F.col(prediction))).withColumn("__b", normalise_product(F.col(reference)))
    rules_ = synonyms.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.lit(True).alias("__syn")).distinct()
    category = (
        F.when(~ok(F.col(reference)), "NON_EVALUABLE_REFERENCE")
        .when(~ok(F.col(prediction)), "ABSTENTION")
        .when(F.col("__a") == F.col("__b"), "EXACT_PRODUCT_AGREEMENT")
        .when(F.col("__syn"), "EQUIVALENT_FUNCTION")
        .otherwise(PENDING)
    )
    return df.join(rules_, ["__a", "__b"], "left").withColumn(name, category).drop("__a", "__b", "__syn")


def token_adjudication(prediction: Column, reference: Column, strong: Column, family_only: Column) -> Column:
    """TX08: automated verdict from shared words; anything doubtful stays unresolvable."""
    p, r = normalise_product(prediction), normalise_product(reference)
    pt, rt = F.array_distinct(F.split(p, " ")), F.array_distinct(F.split(r, " "))
    both = F.size(F.array_intersect(pt, rt))
    either = F.size(F.array_union(pt, rt))
    heads = p.isin("major head protein", "major capsid protein") & r.isin("major head protein", "major capsid protein")
    return (
        F.when(F.coalesce(reference, F.lit("")).rlike(NOT_INFORMATIVE), "NOT_EVALUABLE")
        .when((p == "") | F.coalesce(prediction, F.lit("")).rlike(NOT_INFORMATIVE), "UNRESOLVABLE")
        .when((p == r) | heads, "CORRECT")
        .when((both == F.size(pt)) & (F.size(pt) < F.size(rt)), "TOO_GENERAL")
        .when((both / F.greatest(F.lit(1), either) >= 0.5) & strong & ~family_only, "PARTIALLY_CORRECT")
        .otherwise("UNRESOLVABLE")
    )


def canonical_spanin(product: Column) -> Column:
    """TX09."""
    text = squeeze(F.coalesce(product, F.lit("")))
    return (
        F.when(text.rlike("(?i)^rz(?:-like)? spanin$"), "Rz-like spanin")
        .when(text.rlike("(?i)^rz1(?:-like)? spanin$"), "Rz1-like spanin")
        .otherwise(text)
    )


def module_signal(text: Column) -> Column:
    """TX10: the one module whose keywords occur in the text; null for none or several."""
    found = F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(m)) for m, words in rules.MODULES.items()]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def hallmark_matches(text: Column) -> Column:
    """TX10: every hallmark whose keywords occur in the text."""
    return F.array_compact(F.array(*[F.when(contains_any(text, words), F.lit(h)) for h, words in rules.HALLMARKS.items()]))


def named_product(product: Column) -> Column:
    """TX11: a name that asserts something."""
    text = F.lower(F.trim(F.coalesce(product, F.lit(""))))
    return (text != "") & ~text.rlike(r"hypothetical|unknown|uncharacteri[sz]ed|unnamed|no annotation")
