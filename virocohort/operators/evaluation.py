"""Prediction against reference: matching, scoring, intervals and audits (MT01-MT29)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from virocohort.functions import labels as lb
from virocohort.functions import statistics as st
from virocohort.functions.columns import literal_map, ratio
from virocohort.operators import intervals as iv
from virocohort.operators.families import numbered
from virocohort.operators.matching import mutual_best, ordered_choice, single_choice
from virocohort.operators.orf import biological_start, biological_stop
from virocohort.operators.ordering import running_total
from virocohort.session import cut_lineage

LOCUS = ["genome_id", "s", "e", "strand"]
# fixed category names and weights
CATEGORIES = (
    "EXACT_PRODUCT_AGREEMENT", "EQUIVALENT_FUNCTION", "COMPATIBLE_BUT_BROADER", "COMPATIBLE_BUT_MORE_SPECIFIC",
    "ABSTENTION", "UNSUPPORTED_SPECIFICITY", "GENUINE_FUNCTIONAL_DISAGREEMENT", "NON_EVALUABLE_REFERENCE",
)
CORRECT = CATEGORIES[:2]
COMPATIBLE = CATEGORIES[:4]
UTILITY = {"CORRECT": 1.0, "PARTIALLY_CORRECT": 0.5, "TOO_GENERAL": 0.25, "UNSUPPORTED_SPECIFIC": 0.0, "INCORRECT": 0.0}
RELATION_ORDER = ("EXACT_MATCH", "STOP_DIFFERENCE", "START_DIFFERENCE", "START_AND_STOP_DIFFERENCE", "STRAND_CONFLICT")


def exact_matches(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """MT01: predictions at exactly a reference locus (model ids pred_id, ref_id)."""
    return pred.select(*LOCUS, F.col("model_id").alias("pred_id")).join(ref.select(*LOCUS, F.col("model_id").alias("ref_id")), LOCUS)


def relaxed_candidates(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Pairs left after exact matching that overlap by half the reference and a fifth of the prediction."""
    done = exact_matches(pred, ref)
    p = pred.join(done.select(F.col("pred_id").alias("model_id")), "model_id", "left_anti")
    r = ref.join(done.select(F.col("ref_id").alias("model_id")), "model_id", "left_anti")
    pairs = iv.overlap_join(p.select("genome_id", "strand", F.col("model_id").alias("pred_id"), "s", "e"),
                            r.select("genome_id", "strand", F.col("model_id").alias("ref_id"), F.col("s").alias("rs"), F.col("e").alias("re")), ["genome_id", "strand"], ("s", "e"), ("rs", "re"))
    return pairs.where((F.col("overlap") / iv.length(F.col("rs"), F.col("re")) >= 0.5) & (F.col("overlap") / iv.length(F.col("s"), F.col("e")) >= 0.2))


def relaxed_matches(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """MT02: exact pairs, unique relaxed pairs, and ambiguous predictions withheld with their count."""
    cand = relaxed_candidates(pred, ref)
    per_p = cand.groupBy("pred_id").agg(F.count("*").alias("np"), F.min("ref_id").alias("ref_id"))
    per_r = cand.groupBy("ref_id").agg(F.count("*").alias("nr"))
    judged = per_p.join(per_r, "ref_id")
    one = (F.col("np") == 1) & (F.col("nr") == 1)
    relaxed = judged.select("pred_id", F.when(one, F.col("ref_id")).alias("ref_id"), F.when(one, "RELAXED").otherwise("AMBIGUOUS").alias("mode"), F.col("np").alias("candidates"))
    return exact_matches(pred, ref).select("pred_id", "ref_id", F.lit("EXACT").alias("mode"), F.lit(1).cast("bigint").alias("candidates")).unionByName(relaxed)


def match_audit(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """MT27: outcome of every prediction under both matching modes."""
    exact = pred.select(F.col("model_id").alias("pred_id")).join(exact_matches(pred, ref).select("pred_id", F.lit(True).alias("m")), "pred_id", "left").select(
        "pred_id", F.lit("exact").alias("matching_mode"), F.when(F.col("m"), "MATCHED").otherwise("NO_REFERENCE_MATCH").alias("outcome"))
    rel = pred.select(F.col("model_id").alias("pred_id")).join(relaxed_matches(pred, ref).select("pred_id", "mode"), "pred_id", "left").select(
        "pred_id", F.lit("relaxed").alias("matching_mode"),
        F.when(F.col("mode") == "AMBIGUOUS", "AMBIGUOUS_OVERLAP").when(F.col("mode").isNotNull(), "MATCHED").otherwise("NO_REFERENCE_MATCH").alias("outcome"))
    return exact.unionByName(rel)


def relation(s1, e1, d1, s2, e2, d2) -> Column:
    """Structural relation of two models; a one-base contact is no overlap."""
    shared = iv.overlap(s1, e1, s2, e2)
    same, plus = d1 == d2, d1 == "+"
    return (
        F.when((s1 == s2) & (e1 == e2) & same, "EXACT_MATCH")
        .when(same & (s1 == s2), F.when(plus, "STOP_DIFFERENCE").otherwise("START_DIFFERENCE"))
        .when(same & (e1 == e2), F.when(plus, "START_DIFFERENCE").otherwise("STOP_DIFFERENCE"))
        .when((shared > 1) & ~same, "STRAND_CONFLICT").when(shared > 1, "START_AND_STOP_DIFFERENCE")
    )


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """MT03: relation of every model of two methods, one kind of relation after the other.

    Within a kind, models of ``a`` in order of place take a partner if exactly one is still free; with several, the last
    two kinds call the model complex.  Partners are used up, so each kind is settled over sorted blocks (``single_choice``)
    of overlapping pairs alone; what is left over is complex where it overlaps an unused model, or one-sided.
    """
    side = lambda df, x: df.select("genome_id", F.col("model_id").alias(x), *[F.col(c).alias(c + x) for c in ("s", "e", "strand")])
    pairs = iv.overlap_join(side(a, "p"), side(b, "d"), ["genome_id"], ("sp", "ep"), ("sd", "ed"))
    kind = relation(F.col("sp"), F.col("ep"), F.col("strandp"), F.col("sd"), F.col("ed"), F.col("strandd"))
    pairs = cut_lineage(pairs.select("genome_id", "p", "d", F.struct("sp", "ep", "p").alias("turn"), kind.alias("kind"), (F.col("overlap") > 1).alias("deep")))
    told = pairs.where("false").select("genome_id", F.col("p").alias("a_id"), F.col("d").alias("b_id"), F.lit("").alias("relationship"))
    for n, name in enumerate(RELATION_ORDER):
        open_ = pairs.where(F.col("kind") == name).join(told.select("genome_id", F.col("a_id").alias("p")), ["genome_id", "p"], "left_anti").join(
            told.where("b_id is not null").select("genome_id", F.col("b_id").alias("d")), ["genome_id", "d"], "left_anti")
        settled = single_choice(open_).where("d is not null" if n < 3 else "free > 0")
        told = told.unionByName(settled.select("genome_id", F.col("p").alias("a_id"), F.col("d").alias("b_id"), F.when(F.col("d").isNull(), "COMPLEX").otherwise(name).alias("relationship")))
    used = told.where("b_id is not null").select("genome_id", F.col("b_id").alias("d"))
    touching = pairs.where("deep").join(used, ["genome_id", "d"], "left_anti").select("genome_id", F.col("p").alias("a_id"), F.lit(True).alias("touches")).distinct()
    rest = a.select("genome_id", F.col("model_id").alias("a_id")).join(told.where("a_id is not null").select("genome_id", "a_id"), ["genome_id", "a_id"], "left_anti")
    rest = rest.join(touching, ["genome_id", "a_id"], "left").select("genome_id", "a_id", F.lit(None).cast("string").alias("b_id"), F.when(F.col("touches"), "COMPLEX").otherwise("METHOD_A_ONLY").alias("relationship"))
    alone = b.select("genome_id", F.col("model_id").alias("d")).join(used, ["genome_id", "d"], "left_anti").select(
        "genome_id", F.lit(None).cast("string").alias("a_id"), F.col("d").alias("b_id"), F.lit("METHOD_B_ONLY").alias("relationship"))
    return told.unionByName(rest).unionByName(alone)


def greedy_matches(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """MT04: one-to-one pairs by exact stop, exact start, reciprocal share, overlap and start distance."""
    side = lambda df, x: df.select("genome_id", "strand", F.col("model_id").alias(x), F.col("s").alias("s" + x), F.col("e").alias("e" + x))
    pairs = iv.overlap_join(side(ref, "p"), side(pred, "d"), ["genome_id", "strand"], ("sp", "ep"), ("sd", "ed"))
    stop = lambda x: biological_stop(F.col("s" + x), F.col("e" + x), F.col("strand"))
    start = lambda x: biological_start(F.col("s" + x), F.col("e" + x), F.col("strand"))
    longer = F.greatest(iv.length(F.col("sp"), F.col("ep")), iv.length(F.col("sd"), F.col("ed")))
    share = F.col("overlap") / longer
    edges = pairs.where((stop("p") == stop("d")) | (share >= 0.5))
    rank = F.struct((stop("p") == stop("d")).alias("a"), (start("p") == start("d")).alias("b"), share.alias("c"), F.col("overlap").alias("o"),
                    (-F.abs(start("p") - start("d"))).alias("f"), F.col("p").alias("g"), F.col("d").alias("h"))
    return mutual_best(edges.select("genome_id", "p", "d", rank.alias("rank"), F.col("sp").alias("place"))).select("genome_id", F.col("p").alias("ref_id"), F.col("d").alias("pred_id"))


def stop_comparison(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """MT05: each reference gene takes the closest free prediction with its stop (parts: exon text)."""
    stop = biological_stop(F.col("s"), F.col("e"), F.col("strand"))
    p = pred.select("genome_id", "strand", stop.alias("stop"), F.col("model_id").alias("d"), F.col("s").alias("s1"), F.col("e").alias("e1"), F.col("parts").alias("x1"))
    r = ref.select("genome_id", "strand", stop.alias("stop"), F.col("model_id").alias("p"), "s", "e", "parts")
    pairs = r.join(p, ["genome_id", "strand", "stop"])
    moved = F.abs(F.col("s1") - F.col("s")) + F.abs(F.col("e1") - F.col("e"))
    place = F.row_number().over(Window.partitionBy("genome_id", "p").orderBy("s1", "e1", "d"))  # of full ties the first is taken
    pairs = pairs.withColumn("place", place)
    pref = F.struct((F.col("x1") == F.col("parts")).alias("a"), (moved == 0).alias("b"), (-moved).alias("c"), (-F.col("place")).alias("z"))
    edges = pairs.select("genome_id", "p", "d", F.struct("s", "e", "p").alias("turn"), pref.alias("pref"), F.lit(True).alias("fits"), F.lit(0).alias("overlap"))
    got = ordered_choice(edges).select("genome_id", "p", "d")
    shape = pairs.select("p", "d", F.when(F.col("x1") == F.col("parts"), "exact").when(moved == 0, "structure_mismatch").otherwise("stop_only").alias("outcome"))
    hit = got.join(shape, ["p", "d"])
    missed = r.select("genome_id", "p").join(got.select("p"), "p", "left_anti").select("genome_id", "p", F.lit(None).cast("string").alias("d"), F.lit("missed").alias("outcome"))
    extra = p.select("genome_id", "d").join(got.select("d"), "d", "left_anti").select("genome_id", F.lit(None).cast("string").alias("p"), "d", F.lit("unmatched_prediction").alias("outcome"))
    return hit.select("genome_id", "p", "d", "outcome").unionByName(missed).unionByName(extra).select("genome_id", F.col("p").alias("ref_id"), F.col("d").alias("pred_id"), "outcome")


def compound_comparison(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """MT06: genes with several parts: identical part lists, overlapping parts, or neither.

    Both sides: genome_id, strand, model_id, parts array<struct<s, e>>.
    """
    flat = lambda df, x: df.select("genome_id", "strand", F.col("model_id").alias(x), F.explode("parts").alias("k")).select("genome_id", "strand", x, F.col("k.s").alias("s" + x), F.col("k.e").alias("e" + x))
    text = lambda df, x: df.select(F.col("model_id").alias(x), F.to_json("parts").alias("t" + x), F.size("parts").alias("n" + x))
    pairs = iv.overlap_join(flat(ref, "r"), flat(pred, "p"), ["genome_id", "strand"], ("sr", "er"), ("sp", "ep")).groupBy("genome_id", "r", "p").agg(F.sum("overlap").alias("shared"))
    pairs = pairs.join(text(ref, "r"), "r").join(text(pred, "p"), "p")
    best = pairs.groupBy("genome_id", "r").agg(F.max_by(F.struct("p", "shared", (F.col("tr") == F.col("tp")).alias("same")), F.struct(F.col("tr") == F.col("tp"), "shared", "p")).alias("b"))
    out = ref.select("genome_id", F.col("model_id").alias("r"), F.size("parts").alias("parts_count")).join(best, ["genome_id", "r"], "left")
    return out.select("genome_id", F.col("r").alias("ref_id"), "parts_count", F.col("b.p").alias("pred_id"), F.coalesce("b.shared", F.lit(0)).alias("shared_bases"),
                      F.when(F.col("b.same"), "IDENTICAL_PARTS").when(F.col("b").isNotNull(), "OVERLAPPING_PARTS").otherwise("MISSED").alias("outcome"))


def structural_metrics(pred: DataFrame, ref: DataFrame, relaxed: bool = False) -> DataFrame:
    """MT07/MT25: precision, recall and F1 per genome; relaxed counts any reference half covered."""
    if relaxed:
        hits = iv.overlap_join(pred.select("genome_id", "strand", F.col("model_id").alias("pid"), "s", "e"),
                               ref.select("genome_id", "strand", F.col("model_id").alias("rid"), F.col("s").alias("rs"), F.col("e").alias("re")), ["genome_id", "strand"], ("s", "e"), ("rs", "re"))
        hits = hits.where((F.col("overlap") / iv.length(F.col("rs"), F.col("re")) >= 0.5) & (F.col("overlap") / iv.length(F.col("s"), F.col("e")) >= 0.2))
        tp = hits.groupBy("genome_id").agg(F.count_distinct("pid").alias("tp_pred"), F.count_distinct("rid").alias("tp_ref"))
    else:
        tp = exact_matches(pred, ref).groupBy("genome_id").agg(F.count_distinct("pred_id").alias("tp_pred"), F.count_distinct("ref_id").alias("tp_ref"))
    n = lambda df, x: df.groupBy("genome_id").agg(F.count("*").alias(x))
    out = n(pred, "predicted").join(n(ref, "reference"), "genome_id", "full").join(tp, "genome_id", "left").fillna(0)
    p, r = F.coalesce(ratio(F.col("tp_pred"), F.col("predicted")), F.lit(0.0)), F.coalesce(ratio(F.col("tp_ref"), F.col("reference")), F.lit(0.0))
    return out.select("genome_id", "predicted", "reference", "tp_pred", "tp_ref", p.alias("precision"), r.alias("recall"), st.f1(p, r).alias("f1"))


def truth_metrics(pairs: DataFrame) -> DataFrame:
    """MT08: product assertions at exactly matched loci (observed, expected); abstention is no error."""
    text = lb.normalise_product(F.col("expected"))
    rated = pairs.where((text != "") & ~text.isin("hypothetical protein", "unknown function", "uncharacterized protein", "uncharacterised protein", "conserved phage protein of unknown function"))
    rel = lb.product_relation(F.col("observed"), F.col("expected"))
    g = rated.withColumn("rel", rel).groupBy("genome_id").agg(
        F.count("*").alias("evaluated"), F.count_if(F.col("rel").isin(*CORRECT)).alias("correct"), F.count_if(F.col("rel") == "RIGHT_FUNCTIONALLY_MORE_INFORMATIVE").alias("abstained"))
    wrong = F.col("evaluated") - F.col("correct") - F.col("abstained")
    asserted = F.col("correct") + wrong
    return g.select("genome_id", "evaluated", "correct", wrong.alias("incorrect"), "abstained", ratio(F.col("correct"), asserted).alias("asserted_product_precision"),
                    ratio(asserted, F.col("evaluated")).alias("functional_coverage"), ratio(F.col("correct"), F.col("evaluated")).alias("overall_product_accuracy"))


def concordance_summary(categories: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MT09: seven ratios per group with score intervals; null with identification bounds while reviews are pending."""
    c = F.col("category")
    g = categories.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(c == "NON_EVALUABLE_REFERENCE").alias("off"), F.count_if(c == "ABSTENTION").alias("abst"), F.count_if(c.isin(*CORRECT)).alias("correct"),
        F.count_if(c.isin(*COMPATIBLE)).alias("compatible"), F.count_if(c == lb.PENDING).alias("pending"), F.count_if(c == "UNSUPPORTED_SPECIFICITY").alias("unsupported"),
        F.count_if(c == "GENUINE_FUNCTIONAL_DISAGREEMENT").alias("disagree"))
    g = g.withColumn("n", F.col("total") - F.col("off")).withColumn("named", F.col("n") - F.col("abst"))
    metrics = {"functional_coverage": ("named", "n", False), "strict_functional_precision": ("correct", "named", True), "expanded_compatible_precision": ("compatible", "named", True),
               "functional_recall": ("correct", "n", True), "abstention_rate": ("abst", "n", False), "unsupported_specificity_rate": ("unsupported", "named", True), "genuine_disagreement_rate": ("disagree", "named", True)}
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(k).alias("numerator"), F.col(d).alias("denominator"), F.lit(w).alias("waits")) for m, (k, d, w) in metrics.items()]))
    long = g.select(*keys, "pending", rows.alias("m")).select(*keys, "pending", "m.*")
    open_ = F.col("waits") & (F.col("pending") > 0)
    low, high = st.wilson(F.col("numerator"), F.col("denominator"))
    return long.select(*keys, "metric", "numerator", "denominator", F.when(~open_, ratio(F.col("numerator"), F.col("denominator"))).alias("value"), F.when(~open_, low).alias("ci95_low"), F.when(~open_, high).alias("ci95_high"),
                       F.when(open_, ratio(F.col("numerator"), F.col("denominator"))).alias("identification_low"), F.when(open_, ratio(F.col("numerator") + F.col("pending"), F.col("denominator"))).alias("identification_high"))


def paired_test(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MT10: exact McNemar test of two tools' categories (left, right); null while a review is pending."""
    use = ~((F.col("left") == "NON_EVALUABLE_REFERENCE") | (F.col("right") == "NON_EVALUABLE_REFERENCE"))
    a, b = F.col("left").isin(*CORRECT), F.col("right").isin(*CORRECT)
    g = pairs.groupBy(*keys).agg(F.count_if(use).alias("paired_loci"), F.count_if(use & a & ~b).alias("left_correct_only"), F.count_if(use & b & ~a).alias("right_correct_only"),
                                F.bool_or((F.col("left") == lb.PENDING) | (F.col("right") == lb.PENDING)).alias("pending"))
    return g.select(*keys, "paired_loci", "left_correct_only", "right_correct_only", F.when(F.col("pending"), "PENDING_MANUAL_ADJUDICATION").otherwise("DESCRIPTIVE_EXACT_MCNEMAR").alias("status"),
                    F.when(~F.col("pending"), st.mcnemar(F.col("left_correct_only"), F.col("right_correct_only"))).alias("p_value"))


def curated_evaluation(pred: DataFrame, ref: DataFrame, synonyms: DataFrame, adjudications: DataFrame) -> DataFrame:
    """MT11: category of every reference locus, human verdicts replacing pending ones only.

    adjudications: genome_id, s, e, strand, verdict.
    """
    joined = ref.select(*LOCUS, F.col("product").alias("reference")).join(pred.select(*LOCUS, F.col("product").alias("prediction"), F.lit(True).alias("found")), LOCUS, "left")
    scored = lb.concordance(joined, "prediction", "reference", synonyms, name="auto").join(adjudications, LOCUS, "left")
    category = F.when((F.col("auto") == lb.PENDING) & F.col("verdict").isNotNull(), F.col("verdict")).otherwise(F.col("auto"))
    return scored.select(*LOCUS, "reference", "prediction", category.alias("category"), F.coalesce("found", F.lit(False)).alias("model_found"),
                         (category == lb.PENDING).alias("needs_review"), (F.col("verdict").isNotNull() & (F.col("auto") != lb.PENDING)).alias("unused_verdict"))


def disagreement_triage(a: DataFrame, b: DataFrame, ref: DataFrame) -> DataFrame:
    """MT12: three product tables side by side by locus, with the kind of disagreement."""
    side = lambda df, x: df.select(*LOCUS, F.col("product").alias(x), F.lit(True).alias("has_" + x))
    t = side(a, "a").join(side(b, "b"), LOCUS, "full").join(side(ref, "ref"), LOCUS, "full")
    ia, ib = lb.informative_historical(F.col("a")), lb.informative_historical(F.col("b"))
    category = (
        F.when(F.col("has_a").isNull() & F.col("has_b").isNull(), "MODEL_MISSING_BOTH").when(F.col("has_a").isNull(), "MODEL_MISSING_A").when(F.col("has_b").isNull(), "MODEL_MISSING_B")
        .when(lb.normalise_product(F.col("a")) == lb.normalise_product(F.col("b")), "SAME_NORMALIZED_LABEL").when(~ia & ~ib, "BOTH_UNNAMED")
        .when(~ia, "A_UNNAMED_B_NAMED").when(~ib, "A_NAMED_B_UNNAMED").otherwise("DIFFERENT_NAMED_LABELS")
    )
    return t.select(*LOCUS, F.col("a").alias("product_a"), F.col("b").alias("product_b"), F.col("ref").alias("reference_product"), F.col("has_ref").isNotNull().alias("reference_model_present"), category.alias("category"))


def exclusive_names(mine: DataFrame, other: DataFrame, ref: DataFrame, synonyms: DataFrame) -> DataFrame:
    """MT13: loci named here and unnamed there, with their category against the reference."""
    t = mine.select(*LOCUS, F.col("product").alias("mine")).join(other.select(*LOCUS, F.col("product").alias("other")), LOCUS, "left").join(ref.select(*LOCUS, F.col("product").alias("reference")), LOCUS, "left")
    t = t.where(lb.informative(F.col("mine")) & ~lb.informative(F.col("other")))
    return lb.concordance(t, "mine", "reference", synonyms)


def utility(judgments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MT14: utility bounds; an unresolvable unit is missing, never zero."""
    w = literal_map(UTILITY)[F.col("judgment")]
    g = judgments.groupBy(*keys).agg(
        F.count("*").alias("units"), F.count_if(F.col("judgment") == "NOT_EVALUABLE").alias("not_evaluable"), F.count_if((F.col("judgment") != "NOT_EVALUABLE") & w.isNull()).alias("missing"),
        F.sum(F.coalesce(w, F.lit(0.0))).alias("utility_sum"))
    n = F.col("units") - F.col("not_evaluable")
    return g.select(*keys, "units", "not_evaluable", "missing", "utility_sum", ratio(F.col("utility_sum"), n).alias("lower_bound"), ratio(F.col("utility_sum") + F.col("missing"), n).alias("upper_bound"))


def sign_flip_test(diffs: DataFrame, scale: int = 1_000_000_000) -> DataFrame:
    """MT15: exact paired permutation over all sign vectors (unit, diff).

    The distribution of the signed sums is built up unit by unit as a table of (sum, share of the vectors): each round joins
    nothing and merges equal sums, so its size is that of distinct sums, at most the range of sums in steps of 1 / ``scale``, in
    which differences are taken.  Real-valued differences of many units need a coarser ``scale``; a sum is then off by half a
    step for each unit at most.  The interval is that of the null distribution: the vectors at ranks ceil(0.025 n) and
    floor(0.975 n) + 1.
    """
    spark = diffs.sparkSession
    steps = [r[0] for r in diffs.select(F.round(F.col("diff") * scale).cast("long").alias("d")).collect()]  # one number per unit of the panel
    n, observed = len(steps), sum(steps)
    dist = spark.range(1).select(F.lit(0).cast("long").alias("v"), F.lit(1.0).alias("n"))
    for k, d in enumerate(steps):
        both = dist.select(F.explode(F.array(F.col("v") + d, F.col("v") - d)).alias("v"), (F.col("n") / 2).alias("n"))
        dist = both.groupBy("v").agg(F.sum("n").alias("n"))
        if k % 6 == 5:
            dist = cut_lineage(dist)
    total = 1 << n
    before = ordering_total(dist)
    low, high = max(0, -(-total * 25 // 1000) - 1), min(total - 1, total * 975 // 1000)
    at = lambda rank: F.min(F.when(F.col("upto") > F.lit(rank / total), F.col("v"))) / (scale * max(n, 1))
    extreme = F.sum(F.when(F.abs("v") >= abs(observed), F.col("n")))
    return before.agg(F.lit(observed / scale / n if n else None).cast("double").alias("estimate"), F.lit(n).alias("units"), extreme.alias("p_value"), at(low).alias("null_low"), at(high).alias("null_high"))


def ordering_total(dist: DataFrame) -> DataFrame:
    """The distribution with ``upto``, the share of the vectors up to each sum."""
    span = dist.agg(F.max(F.abs("v"))).first()[0] or 0
    return running_total(dist, [], "v", ["v"], F.col("n"), "upto", max(1, span // 64), "double")


def genome_bootstrap(diffs: DataFrame, iterations: int = 20_000, seed: int = 12020260918) -> DataFrame:
    """MT16: estimate and percentile interval of the mean difference over resampled units (order statistics).

    Draws are md5 hashes of (seed, iteration, draw) and so the same on every run, cluster and engine.
    """
    indexed = numbered(diffs.withColumn("h", F.md5("unit")), "h", "i", 0)
    n = indexed.agg(F.count("*").alias("n"))
    draws = diffs.sparkSession.range(iterations).withColumn("n", n.scalar()).withColumn("d", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "id", "d")), 1, 12), 16, 10).cast("bigint")
    draws = draws.select("id", F.pmod(drawn, F.col("n")).alias("i"))
    means = draws.join(indexed, "i").groupBy("id").agg(F.round(F.avg("diff"), 12).alias("m"))
    ranked = running_total(means, [], "m", ["m", "id"], F.lit(1), "at", 0.01)
    pick = lambda k: F.max(F.when(F.col("at") == k + 1, F.col("m")))
    found = ranked.agg(F.count("*").alias("iterations"), pick(int(0.025 * iterations)).alias("ci95_low"), pick(int(0.975 * iterations) - 1).alias("ci95_high"))
    return found.withColumn("estimate", diffs.agg(F.avg("diff")).scalar())


def decision_changes(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """MT18: fields that differ between two runs; coordinates must not have moved."""
    b = before.select("protein_id", F.struct("s", "e", "strand").alias("at0"), *[F.col(f).alias("b_" + f) for f in fields])
    a = after.select("protein_id", F.struct("s", "e", "strand").alias("at1"), *[F.col(f).alias("a_" + f) for f in fields])
    j = b.join(a, "protein_id")
    changed = F.array_compact(F.array(*[F.when(~F.col("b_" + f).eqNullSafe(F.col("a_" + f)), F.lit(f)) for f in fields]))
    out = j.select("protein_id", F.array_join(changed, ";").alias("changed_fields"), (F.col("at0") != F.col("at1")).alias("coordinates_moved"))
    return out.where("changed_fields <> '' or coordinates_moved")


def panel_summary(categories: DataFrame, panels: DataFrame) -> DataFrame:
    """MT19: the summary of each panel and of all panels together (panels: genome_id, panel)."""
    member = categories.join(panels, "genome_id").select("category", F.explode(F.array("panel", F.lit("combined"))).alias("panel"))
    return concordance_summary(member, ["panel"])


def tool_pairs(models: DataFrame) -> DataFrame:
    """MT20: exact agreements and product relations of every pair of tools (models carry tool, product)."""
    side = lambda x: models.select(*LOCUS, F.col("tool").alias("tool_" + x), F.col("product").alias("p_" + x))
    rel = lb.product_relation(F.col("p_a"), F.col("p_b"))
    return side("a").join(side("b"), LOCUS).where("tool_a < tool_b").groupBy("tool_a", "tool_b", rel.alias("relation")).agg(F.count("*").alias("loci"))


def tool_hypotheticals(models: DataFrame) -> DataFrame:
    """MT20: named and hypothetical products per tool."""
    vague = F.lower(F.coalesce("product", F.lit("hypothetical"))).rlike("hypothetical|unknown function|uncharacterized|uncharacterised")
    return models.groupBy("tool").agg(F.count("*").alias("cds_count"), F.count_if(~vague).alias("specific_annotations"), F.count_if(vague).alias("hypothetical"))


def calibration_bins(records: DataFrame, bins: Sequence[str] = ("HIGH", "MEDIUM", "LOW", "WEAK", "NONE")) -> DataFrame:
    """MT21: observed accuracy per confidence bin, empty bins included (confidence, correct)."""
    grid = records.sparkSession.createDataFrame([(b,) for b in bins], "confidence string")
    g = records.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    out = grid.join(g, "confidence", "left").fillna(0)
    return out.select("confidence", F.col("n").alias("reviewed_n"), F.col("c").alias("correct_n"), ratio(F.col("c"), F.col("n")).alias("observed_accuracy"), F.when(F.col("n") > 0, "MEASURED").otherwise("NO_REVIEW_DATA").alias("calibration_status"))


def start_offsets(pairs: DataFrame) -> DataFrame:
    """MT22: signed start offset of matched models (strand, rs, re, s, e): negative means upstream."""
    offset = F.when(F.col("strand") == "+", F.col("s") - F.col("rs")).otherwise(F.col("re") - F.col("e"))
    stop = biological_stop(F.col("s"), F.col("e"), F.col("strand")) == biological_stop(F.col("rs"), F.col("re"), F.col("strand"))
    return pairs.select("*", offset.alias("start_offset_nt"), (offset == 0).alias("exact_start"), stop.alias("exact_stop"))


def revision_diff(before: DataFrame, after: DataFrame, ref: DataFrame) -> DataFrame:
    """MT23: models that moved between revisions, and exact reference matches gained or lost."""
    known = ref.select(*LOCUS).distinct().withColumn("hit", F.lit(True))
    tag = lambda df, x: df.join(known, LOCUS, "left").select("genome_id", "model_id", F.struct("s", "e", "strand").alias("at" + x), biological_stop(F.col("s"), F.col("e"), F.col("strand")).alias("stop" + x), F.coalesce("hit", F.lit(False)).alias("hit" + x))
    j = tag(before, "0").join(tag(after, "1"), ["genome_id", "model_id"], "full")
    change = F.when(F.col("at0").isNull(), "ADDED").when(F.col("at1").isNull(), "REMOVED").when(F.col("at0") != F.col("at1"), "MOVED")
    return j.withColumn("change", change).where("change is not null").select(
        "genome_id", "model_id", "change", (F.col("stop0") == F.col("stop1")).alias("same_stop"), (F.coalesce("hit1", F.lit(False)) & ~F.coalesce("hit0", F.lit(False))).alias("gained_exact"),
        (F.coalesce("hit0", F.lit(False)) & ~F.coalesce("hit1", F.lit(False))).alias("lost_exact"))


def export_differences(tables: dict[str, DataFrame], fields: Sequence[str]) -> DataFrame:
    """MT24: fields on which exports of the same models disagree, in long form."""
    names = list(tables)
    out = None
    for other in names[1:]:
        a = tables[names[0]].select("model_id", *[F.col(f).cast("string").alias("a_" + f) for f in fields], F.lit(True).alias("in_a"))
        b = tables[other].select("model_id", *[F.col(f).cast("string").alias("b_" + f) for f in fields], F.lit(True).alias("in_b"))
        cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col("a_" + f).alias("left"), F.col("b_" + f).alias("right")) for f in fields]))
        diff = a.join(b, "model_id", "full").select("model_id", F.lit(f"{names[0]}:{other}").alias("exports"), cells.alias("c")).select("model_id", "exports", "c.*").where("not (left <=> right)")
        out = diff if out is None else out.unionByName(diff)
    return out


def structural_categories(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """MT26: where each prediction lies against the reference, counted per genome.

    Half and a fifth of the shorter model separate substantial, partial and thin overlap; predictions
    under 150 bases without overlap count as small ORFs.  These two limits are choices of this library.
    """
    pairs = iv.overlap_join(pred.select("genome_id", "model_id", "s", "e", F.col("strand").alias("d")),
                            ref.select("genome_id", F.col("s").alias("rs"), F.col("e").alias("re"), F.col("strand").alias("rd")), ["genome_id"], ("s", "e"), ("rs", "re"))
    same = F.col("d") == F.col("rd")
    share = F.col("overlap") / F.least(iv.length(F.col("s"), F.col("e")), iv.length(F.col("rs"), F.col("re")))
    stop = biological_stop(F.col("s"), F.col("e"), F.col("d")) == biological_stop(F.col("rs"), F.col("re"), F.col("d"))
    start = biological_start(F.col("s"), F.col("e"), F.col("d")) == biological_start(F.col("rs"), F.col("re"), F.col("d"))
    rank = (
        F.when(same & stop & start, 1).when(same & stop, 2).when(same & start, 3).when(same & (share >= 0.5), 4).when(same & (share >= 0.2), 5).when(~same & (share >= 0.5), 6).otherwise(7)
    )
    best = pairs.groupBy("model_id").agg(F.min(rank).alias("r"))
    names = {1: "A_EXACT", 2: "B_SAME_STOP", 3: "C_SAME_START", 4: "D_SUBSTANTIAL_SAME_STRAND", 5: "E_PARTIAL_SAME_STRAND", 6: "F_ANTISENSE", 7: "I_NO_MEANINGFUL_OVERLAP"}
    out = pred.join(best, "model_id", "left")
    cat = F.when(F.col("r").isNull(), F.when(F.col("e") - F.col("s") + 1 < 150, "H_SMALL_ORF").otherwise("G_INTERGENIC")).otherwise(literal_map(names)[F.col("r")])
    return out.groupBy("genome_id", cat.alias("category")).agg(F.count("*").alias("predictions"))


def caller_count_invariant(primary: DataFrame, final: DataFrame) -> DataFrame:
    """MT28: genomes whose final gene count differs from the primary caller's."""
    n = lambda df, x: df.groupBy("genome_id").agg(F.count("*").alias(x))
    j = n(primary, "primary_cds").join(n(final, "final_cds"), "genome_id", "full").fillna(0)
    return j.withColumn("consistent", F.col("primary_cds") == F.col("final_cds"))


def frozen_counts(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """MT29: recomputed counts that differ from the pinned ones (metric, count)."""
    j = counts.join(expected.withColumnRenamed("count", "expected"), "metric", "full")
    return j.where("not (count <=> expected)")
