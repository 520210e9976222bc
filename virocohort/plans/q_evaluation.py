"""Prediction-versus-reference queries (MT01-MT29)."""

from pyspark.sql import functions as F

from virocohort.functions import labels as lb
from virocohort.functions import statistics as st
from virocohort.operators import evaluation as mt
from virocohort.plans.q_evidence import CATEGORY, SYN, synonyms
from virocohort.plans.registry import query
from virocohort.plans.tables import load

# one model per locus and caller; names follow position so that callers sometimes agree
PRODUCT = "case (s div_ 120) % 6 when 0 then 'major capsid protein' when 1 then 'Holin' when 2 then 'hypothetical protein' when 3 then 'tail fiber protein' when 4 then 'terminase' else 'DUF77 family' end"
ALT = "case (s div_ 120 + e) % 7 when 0 then 'major head protein' when 1 then 'holin' when 2 then 'tail fiber protein' when 3 then 'tail protein' when 4 then null when 5 then 'hypothetical protein containing kinase' else 'major capsid protein' end"
duck = lambda t: t.replace("div_", "//")
spark_ = lambda t: t.replace("div_", "div")
PR = f"""dd as (select genome_id, s, e, strand, provider, min(model_id) model_id from sparse_models group by all), pred as (select *, {duck(ALT)} product from dd where provider = 'phanotate'),
 refs as (select *, {duck(PRODUCT)} product from dd where provider = 'prodigal_gv')"""
OVL = "least(p.e, r.e) - greatest(p.s, r.s) + 1"


def pred_ref(spark, sf):
    m = load(spark, sf, "sparse_models").groupBy("genome_id", "s", "e", "strand", "provider").agg(F.min("model_id").alias("model_id"))
    return (m.where("provider = 'phanotate'").withColumn("product", F.expr(spark_(ALT))), m.where("provider = 'prodigal_gv'").withColumn("product", F.expr(spark_(PRODUCT))))


EX = "ex as (select p.model_id pred_id, r.model_id ref_id, genome_id, s, e, strand, p.product observed, r.product expected from pred p join refs r using (genome_id, s, e, strand))"
RLX = f"""{EX}, cd as (select p.model_id pred_id, r.model_id ref_id from pred p join refs r on p.genome_id = r.genome_id and p.strand = r.strand and p.s <= r.e and p.e >= r.s
   where p.model_id not in (select pred_id from ex) and r.model_id not in (select ref_id from ex) and ({OVL}) / (r.e - r.s + 1) >= 0.5 and ({OVL}) / (p.e - p.s + 1) >= 0.2),
 np as (select pred_id, count(*) np, min(ref_id) ref_id from cd group by 1), nr as (select ref_id, count(*) nr from cd group by 1),
 rel as (select pred_id, ref_id, 'EXACT' as mode, 1 candidates from ex union all select pred_id, case when np = 1 and nr = 1 then ref_id end, case when np = 1 and nr = 1 then 'RELAXED' else 'AMBIGUOUS' end, np from np join nr using (ref_id))"""


@query("mt01_exact_matches", "sparse_models", f"with {PR}, {EX} select pred_id, ref_id from ex")
def mt01(spark, sf):
    return mt.exact_matches(*pred_ref(spark, sf)).select("pred_id", "ref_id")


@query("mt02_relaxed_matches", "sparse_models", f"with {PR}, {RLX} select * from rel")
def mt02(spark, sf):
    return mt.relaxed_matches(*pred_ref(spark, sf))


@query("mt03_priority_relations")
def mt03(spark, sf):
    return mt.compare_models(*pred_ref(spark, sf))


@query("mt04_greedy_matches")
def mt04(spark, sf):
    p, r = pred_ref(spark, sf)
    return mt.greedy_matches(r, p)


PARTS = "concat(cast(s as string), '..', cast(e as string), case when e % 4 = 0 then ',x' else '' end)"


@query("mt05_stop_comparison")
def mt05(spark, sf):
    p, r = pred_ref(spark, sf)
    return mt.stop_comparison(p.withColumn("parts", F.expr(PARTS)), r.withColumn("parts", F.expr("concat(cast(s as string), '..', cast(e as string))")))


@query("mt06_compound_locations", "sparse_models", f"""
with {PR}, pp as (select *, case when e - s >= 200 then [(s, s + 89), (s + 120, e)] else [(s, e)] end parts from pred), rp as (select *, case when e - s >= 200 and s % 9 = 1 then [(s, s + 89), (s + 120, e)] else [(s, e)] end parts from refs),
 pf as (select genome_id, strand, model_id p, parts pt, unnest(parts) k from pp), rf as (select genome_id, strand, model_id r, parts rt, unnest(parts) k from rp),
 o as (select rf.r, pf.p, rt = pt same, sum(least(rf.k[2], pf.k[2]) - greatest(rf.k[1], pf.k[1]) + 1) sh from rf join pf on rf.genome_id = pf.genome_id and rf.strand = pf.strand and rf.k[1] <= pf.k[2] and rf.k[2] >= pf.k[1] group by all),
 b as (select r, arg_max(struct_pack(p := p, sh := sh, same := same), (same, sh, p)) b from o group by 1)
select rp.genome_id, rp.model_id ref_id, len(parts) parts_count, b.p pred_id, coalesce(b.sh, 0)::bigint shared_bases, case when b.same then 'IDENTICAL_PARTS' when b is not null then 'OVERLAPPING_PARTS' else 'MISSED' end outcome from rp left join b on b.r = rp.model_id""")
def mt06(spark, sf):
    p, r = pred_ref(spark, sf)
    two, one = "array(struct(s, s + 89 as e), struct(s + 120 as s, e))", "array(struct(s, e))"
    return mt.compound_comparison(p.withColumn("parts", F.expr(f"if(e - s >= 200, {two}, {one})")), r.withColumn("parts", F.expr(f"if(e - s >= 200 and s % 9 = 1, {two}, {one})")))


def metrics_sql(tp):
    return f"""n as (select genome_id, count(*) filter (where provider = 'phanotate') predicted, count(*) filter (where provider = 'prodigal_gv') reference from dd group by 1), {tp},
 mm as (select genome_id, predicted, reference, coalesce(tp_pred, 0) tp_pred, coalesce(tp_ref, 0) tp_ref, coalesce(coalesce(tp_pred, 0) / predicted, 0) p, coalesce(coalesce(tp_ref, 0) / reference, 0) r from n left join tp using (genome_id))
select genome_id, predicted, reference, tp_pred, tp_ref, round(p, 6) "precision", round(r, 6) recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) f1 from mm"""


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("mt07_structural_metrics", "sparse_models", f"with {PR}, {EX}, " + metrics_sql("tp as (select genome_id, count(distinct pred_id) tp_pred, count(distinct ref_id) tp_ref from ex group by 1)"))
def mt07(spark, sf):
    return rounded(mt.structural_metrics(*pred_ref(spark, sf)))


@query("mt25_relaxed_structural_score", "sparse_models", f"with {PR}, " + metrics_sql(f"tp as (select p.genome_id, count(distinct p.model_id) tp_pred, count(distinct r.model_id) tp_ref from pred p join refs r on p.genome_id = r.genome_id and p.strand = r.strand and p.s <= r.e and p.e >= r.s where ({OVL}) / (r.e - r.s + 1) >= 0.5 and ({OVL}) / (p.e - p.s + 1) >= 0.2 group by 1)"))
def mt25(spark, sf):
    return rounded(mt.structural_metrics(*pred_ref(spark, sf), relaxed=True))


pair_rel = """case when a = b and a <> '' then 'EXACT' when ua and ub then 'UNKNOWN' when ua then 'RIGHT' when ub then 'LEFT' else 'DIFF' end"""


@query("mt08_truth_metrics", "sparse_models", f"""
with {PR}, {EX}, t as (select genome_id, trim(regexp_replace(replace(replace(lower(coalesce(observed, '')), 'major head protein', 'major capsid protein'), 'terminase protein', 'terminase'), '[^a-z0-9]+', ' ', 'g')) a, trim(regexp_replace(lower(expected), '[^a-z0-9]+', ' ', 'g')) b from ex where expected <> 'hypothetical protein'),
 u as (select genome_id, case when a = b then 'C' when a = '' then 'A' else 'W' end c from t), g as (select genome_id, count(*) ev, count(*) filter (where c = 'C') co, count(*) filter (where c = 'A') ab from u group by 1)
select genome_id, ev evaluated, co correct, ev - co - ab incorrect, ab abstained, round(co / nullif(ev - ab, 0), 6) asserted_product_precision, round((ev - ab) / ev, 6) functional_coverage, round(co / ev, 6) overall_product_accuracy from g""")
def mt08(spark, sf):
    p, r = pred_ref(spark, sf)
    pairs = p.select(*mt.LOCUS, F.col("product").alias("observed")).join(r.select(*mt.LOCUS, F.col("product").alias("expected")), mt.LOCUS)
    return rounded(mt.truth_metrics(pairs))


CATS = f"cats as (select genome_id, strand, s, e, {CATEGORY} category from (select genome_id, s, e, strand, observed product, expected reference from ex))"
REVIEWED = "case when category = 'UNRESOLVED_REVIEW_REQUIRED' then case when s % 5 = 0 then 'COMPATIBLE_BUT_BROADER' when s % 5 = 1 then 'GENUINE_FUNCTIONAL_DISAGREEMENT' when s % 5 = 2 then 'UNSUPPORTED_SPECIFICITY' when genome_id < 'G5' then 'UNRESOLVED_REVIEW_REQUIRED' else 'COMPATIBLE_BUT_MORE_SPECIFIC' end else category end"


def wil(k, n):
    z = st.Z95
    c = f"({k} / {n} + {z * z} / (2 * {n})) / (1 + {z * z} / {n})"
    h = f"{z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z * z} / (4 * {n} * {n})) / (1 + {z * z} / {n})"
    return f"greatest(0, {c} - {h})", f"least(1, {c} + {h})"


lo_, hi_ = wil("k::double", "d::double")


def summary_sql(key, source):
    parts = {"functional_coverage": ("nm", "n", 0), "strict_functional_precision": ("co", "nm", 1), "expanded_compatible_precision": ("cp", "nm", 1), "functional_recall": ("co", "n", 1), "abstention_rate": ("ab", "n", 0),
             "unsupported_specificity_rate": ("us", "nm", 1), "genuine_disagreement_rate": ("gd", "nm", 1)}
    union = " union all ".join(f"select {key}, pe, '{m}' metric, {k} k, {d} d, {w} w from g2" for m, (k, d, w) in parts.items())
    return f"""g as (select {key}, count(*) tot, count(*) filter (where category = 'NON_EVALUABLE_REFERENCE') off, count(*) filter (where category = 'ABSTENTION') ab, count(*) filter (where category in ('EXACT_PRODUCT_AGREEMENT', 'EQUIVALENT_FUNCTION')) co,
  count(*) filter (where category in ('EXACT_PRODUCT_AGREEMENT', 'EQUIVALENT_FUNCTION', 'COMPATIBLE_BUT_BROADER', 'COMPATIBLE_BUT_MORE_SPECIFIC')) cp, count(*) filter (where category = 'UNRESOLVED_REVIEW_REQUIRED') pe, count(*) filter (where category = 'UNSUPPORTED_SPECIFICITY') us, count(*) filter (where category = 'GENUINE_FUNCTIONAL_DISAGREEMENT') gd from {source} group by 1),
 g2 as (select *, tot - off n, tot - off - ab nm from g), lg as ({union})
select {key}, metric, k numerator, d denominator, round(case when w = 0 or pe = 0 then k / nullif(d, 0) end, 6) "value", round(case when (w = 0 or pe = 0) and d > 0 then {lo_} end, 6) ci95_low, round(case when (w = 0 or pe = 0) and d > 0 then {hi_} end, 6) ci95_high,
 round(case when w = 1 and pe > 0 then k / nullif(d, 0) end, 6) identification_low, round(case when w = 1 and pe > 0 then (k + pe) / nullif(d, 0) end, 6) identification_high from lg"""


def categories(spark, sf):
    p, r = pred_ref(spark, sf)
    pairs = p.select(*mt.LOCUS, F.col("product").alias("prediction")).join(r.select(*mt.LOCUS, F.col("product").alias("reference")), mt.LOCUS)
    return lb.concordance(pairs, "prediction", "reference", lb.synonym_pairs(synonyms(spark, sf)))


@query("mt09_concordance_summary", "sparse_models", f"with {PR}, {EX}, {SYN}, {CATS}, rv as (select genome_id, {REVIEWED} category from cats), {summary_sql('genome_id', 'rv')}")
def mt09(spark, sf):
    return rounded(mt.concordance_summary(categories(spark, sf).withColumn("category", F.expr(REVIEWED)), ["genome_id"]))


OTHER = "case when (s + e) % 3 = 0 then 'EXACT_PRODUCT_AGREEMENT' when (s + e) % 3 = 1 then 'ABSTENTION' else 'GENUINE_FUNCTIONAL_DISAGREEMENT' end"
NOPEND = "case when category = 'UNRESOLVED_REVIEW_REQUIRED' and strand = '+' then 'GENUINE_FUNCTIONAL_DISAGREEMENT' else category end"


@query("mt10_paired_test", "sparse_models", f"""
with {PR}, {EX}, {SYN}, {CATS}, q as (select genome_id, {NOPEND} l, {OTHER} r from cats), g as (select genome_id, count(*) filter (where l <> 'NON_EVALUABLE_REFERENCE') n, count(*) filter (where l in ('EXACT_PRODUCT_AGREEMENT', 'EQUIVALENT_FUNCTION') and r <> 'EXACT_PRODUCT_AGREEMENT') b,
  count(*) filter (where r = 'EXACT_PRODUCT_AGREEMENT' and l not in ('EXACT_PRODUCT_AGREEMENT', 'EQUIVALENT_FUNCTION', 'NON_EVALUABLE_REFERENCE')) c, bool_or(l = 'UNRESOLVED_REVIEW_REQUIRED') pe from q group by 1),
 t as (select g.*, (select sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) from range(0, least(b, c) + 1) x(k)) tail from g)
select genome_id, n paired_loci, b left_correct_only, c right_correct_only, case when pe then 'PENDING_MANUAL_ADJUDICATION' else 'DESCRIPTIVE_EXACT_MCNEMAR' end status, round(case when not pe then case when b + c = 0 then 1 else least(1, 2 * tail) end end, 6) p_value from t""")
def mt10(spark, sf):
    q = categories(spark, sf).select("genome_id", F.expr(NOPEND).alias("left"), F.expr(OTHER).alias("right"))
    return rounded(mt.paired_test(q, ["genome_id"]))


VERDICTS = "select genome_id, s, e, strand, case when s % 2 = 0 then 'COMPATIBLE_BUT_BROADER' else 'GENUINE_FUNCTIONAL_DISAGREEMENT' end verdict from {refs} where e % 3 = 0"


@query("mt11_curated_evaluation", "sparse_models", f"""
with {PR}, {SYN}, v as ({VERDICTS.format(refs='refs')}), j as (select r.genome_id, r.s, r.e, r.strand, r.product reference, p.product, p.model_id is not null found, verdict from refs r left join pred p using (genome_id, s, e, strand) left join v using (genome_id, s, e, strand)),
 c as (select *, {CATEGORY} auto from j), f as (select *, case when auto = 'UNRESOLVED_REVIEW_REQUIRED' and verdict is not null then verdict else auto end category from c)
select genome_id, s, e, strand, reference, product prediction, category, found model_found, category = 'UNRESOLVED_REVIEW_REQUIRED' needs_review, verdict is not null and auto <> 'UNRESOLVED_REVIEW_REQUIRED' unused_verdict from f""")
def mt11(spark, sf):
    p, r = pred_ref(spark, sf)
    return mt.curated_evaluation(p, r, lb.synonym_pairs(synonyms(spark, sf)), spark.sql(VERDICTS, refs=r))


norm = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
inf = lambda c: f"({norm(c)} <> '' and not regexp_matches({norm(c)}, 'hypothetical'))"


@query("mt12_disagreement_triage", "sparse_models", f"""
with {PR}, third as (select * from refs where e % 2 = 0), j as (select genome_id, s, e, strand, p.product a, r.product b, t.product ref, p.model_id ia, r.model_id ib, t.model_id it from pred p full join refs r using (genome_id, s, e, strand) full join third t using (genome_id, s, e, strand))
select genome_id, s, e, strand, a product_a, b product_b, ref reference_product, it is not null reference_model_present, case when ia is null and ib is null then 'MODEL_MISSING_BOTH' when ia is null then 'MODEL_MISSING_A' when ib is null then 'MODEL_MISSING_B' when {norm('a')} = {norm('b')} then 'SAME_NORMALIZED_LABEL'
 when not {inf('a')} and not {inf('b')} then 'BOTH_UNNAMED' when not {inf('a')} then 'A_UNNAMED_B_NAMED' when not {inf('b')} then 'A_NAMED_B_UNNAMED' else 'DIFFERENT_NAMED_LABELS' end category from j""")
def mt12(spark, sf):
    p, r = pred_ref(spark, sf)
    return mt.disagreement_triage(p, r, r.where("e % 2 = 0"))


@query("mt13_exclusive_names", "sparse_models", f"""
with {PR}, {SYN}, j as (select p.genome_id, p.s, p.e, p.strand, p.product, r.product other, r.product reference from pred p left join refs r using (genome_id, s, e, strand)), k as (select *, {CATEGORY} category from j)
select genome_id, s, e, strand, product mine, category from k where {inf('product')} and (not {inf('other')} or regexp_matches({norm('other')}, 'duf'))""")
def mt13(spark, sf):
    p, r = pred_ref(spark, sf)
    return mt.exclusive_names(p, r, r, lb.synonym_pairs(synonyms(spark, sf))).select(*mt.LOCUS, "mine", "category")


JUDGE = "case s % 7 when 0 then 'CORRECT' when 1 then 'PARTIALLY_CORRECT' when 2 then 'TOO_GENERAL' when 3 then 'UNSUPPORTED_SPECIFIC' when 4 then 'UNRESOLVABLE' when 5 then 'NOT_EVALUABLE' else 'INCORRECT' end"
MODELS = "select genome_id, provider tool, s div_ 3 as s0, (s + e) div_ 7 as s from {m}"
UTIL = f"""jm as ({duck(MODELS).format(m='sparse_models')}), jd as (select genome_id, tool, {JUDGE} judgment from jm),
 ut as (select genome_id, tool, count(*) units, count(*) filter (where judgment = 'NOT_EVALUABLE') ne, count(*) filter (where judgment = 'UNRESOLVABLE') ms, sum(case judgment when 'CORRECT' then 1 when 'PARTIALLY_CORRECT' then 0.5 when 'TOO_GENERAL' then 0.25 else 0 end)::double us from jd group by 1, 2)"""


def judgments(spark, sf):
    return spark.sql(spark_(MODELS), m=load(spark, sf, "sparse_models")).withColumn("judgment", F.expr(JUDGE))


@query("mt14_genome_utility", "sparse_models", f"with {UTIL} select genome_id, tool, units, ne not_evaluable, ms missing, us utility_sum, round(us / nullif(units - ne, 0), 6) lower_bound, round((us + ms) / nullif(units - ne, 0), 6) upper_bound from ut")
def mt14(spark, sf):
    return rounded(mt.utility(judgments(spark, sf), ["genome_id", "tool"]))


# paired units for the exact test: ten bands of genomes
BANDS = f"""{UTIL}, bd as (select right(genome_id, 1) unit, tool, sum(us) / sum(units - ne) u from ut group by 1, 2), df as (select unit, round(max(u) filter (where tool = 'phanotate') - max(u) filter (where tool = 'prodigal_gv'), 9) diff from bd group by 1)"""


def band_diffs(spark, sf):
    u = mt.utility(judgments(spark, sf), ["genome_id", "tool"])
    b = u.groupBy(F.expr("right(genome_id, 1)").alias("unit"), "tool").agg((F.sum("utility_sum") / F.sum(F.col("units") - F.col("not_evaluable"))).alias("u"))
    pick = lambda t: F.max(F.when(F.col("tool") == t, F.col("u")))
    return b.groupBy("unit").agg(F.round(pick("phanotate") - pick("prodigal_gv"), 9).alias("diff"))


@query("mt15_sign_flip_test", "sparse_models", f"""
with {BANDS}, o as (select *, row_number() over (order by unit) - 1 i from df), sg as (select v.range id, sum(case when (v.range >> i) & 1 = 1 then diff else -diff end) / 10 m from range(0, 1024) v, o group by 1), ob as (select sum(diff) / 10 x from o)
select round(x, 6) estimate, 10 units, round(count(*) filter (where abs(m) >= abs(x) - 1e-9) / 1024, 6) p_value, round((list(m order by m))[26], 6) null_low, round((list(m order by m))[999], 6) null_high from sg, ob group by x""")
def mt15(spark, sf):
    return rounded(mt.sign_flip_test(band_diffs(spark, sf)))


@query("mt16_genome_bootstrap", "sparse_models", f"""
with {BANDS}, ix as (select diff, row_number() over (order by md5(unit)) - 1 i, count(*) over () n from df),
 dr as (select it.range id, ('0x' || substr(md5('12020260918-' || it.range || '-' || d.range), 1, 12))::bigint % (select max(n) from ix) i from range(0, 20000) it, range(1, (select max(n) + 1 from ix)) d),
 mm as (select round(avg(diff), 12) m from dr join ix using (i) group by id)
select count(*) iterations, round((list(m order by m))[501], 6) ci95_low, round((list(m order by m))[19500], 6) ci95_high, round((select avg(diff) from df), 6) estimate from mm""")
def mt16(spark, sf):
    return rounded(mt.genome_bootstrap(band_diffs(spark, sf), iterations=20_000))


l1, h1 = wil("k1::double", "n1::double")
l2, h2 = wil("k2::double", "n2::double")


@query("mt17_difference_interval", "sparse_models", f"""
with {UTIL}, x as (select genome_id, sum(us) filter (where tool = 'phanotate') k1, sum(units) filter (where tool = 'phanotate') n1, sum(us) filter (where tool = 'prodigal_gv') k2, sum(units) filter (where tool = 'prodigal_gv') n2 from ut group by 1)
select genome_id, round(k1 / n1 - k2 / n2, 6) estimate, round({l1} - ({h2}), 6) low, round({h1} - ({l2}), 6) high from x""")
def mt17(spark, sf):
    u = mt.utility(judgments(spark, sf), ["genome_id", "tool"])
    pick = lambda c, t: F.sum(F.when(F.col("tool") == t, F.col(c)))
    x = u.groupBy("genome_id").agg(pick("utility_sum", "phanotate").alias("k1"), pick("units", "phanotate").alias("n1"), pick("utility_sum", "prodigal_gv").alias("k2"), pick("units", "prodigal_gv").alias("n2"))
    est, low, high = st.difference_interval(*[F.col(c) for c in ("k1", "n1", "k2", "n2")])
    return rounded(x.select("genome_id", est.alias("estimate"), low.alias("low"), high.alias("high")))


AFTER = "select protein_id, s, case when e % 50 = 0 then e + 3 else e end e, strand, case when s % 9 = 0 then 'portal protein' else proposed_function end proposed_function, case when s % 11 = 0 then 'LOW' else confidence end confidence from {c}"


@query("mt18_decision_changes", "classified", f"""
with a as ({AFTER.format(c='classified')}), j as (select b.protein_id, b.proposed_function is distinct from a.proposed_function f, b.confidence is distinct from a.confidence c, (b.s, b.e, b.strand) <> (a.s, a.e, a.strand) mv from classified b join a using (protein_id))
select protein_id, concat_ws(';', case when f then 'proposed_function' end, case when c then 'confidence' end) changed_fields, mv coordinates_moved from j where f or c or mv""")
def mt18(spark, sf):
    c = load(spark, sf, "classified")
    return mt.decision_changes(c, spark.sql(AFTER, c=c), ["proposed_function", "confidence"])


PANEL = "select genome_id, case when genome_id < 'G5' then 'original' else 'external' end panel from {g}"


@query("mt19_panel_summary", "sparse_models", f"with {PR}, {EX}, {SYN}, {CATS}, pl as (select unnest([case when genome_id < 'G5' then 'original' else 'external' end, 'combined']) panel, category from cats), {summary_sql('panel', 'pl')}")
def mt19(spark, sf):
    c = categories(spark, sf)
    return rounded(mt.panel_summary(c, spark.sql(PANEL, g=c.select("genome_id").distinct())))


TOOLS = "select genome_id, s, e, strand, provider tool, min(model_id) model_id, case when min(e) % 4 = 0 then 'hypothetical protein' when min(model_id) like '%_1_%' then 'terminase protein' when min(model_id) like '%_2_%' then 'terminase' else 'holin' end product from {m} group by genome_id, s, e, strand, provider"


@query("mt20_tool_pairs", "sparse_models", f"""
with t as ({TOOLS.format(m='sparse_models')}), x as (select a.tool tool_a, b.tool tool_b, replace(a.product, 'terminase protein', 'terminase') p, replace(b.product, 'terminase protein', 'terminase') q from t a join t b using (genome_id, s, e, strand) where a.tool < b.tool)
select tool_a, tool_b, case when p = q then 'EXACT_PRODUCT_AGREEMENT' when p like 'hypo%' then 'RIGHT_FUNCTIONALLY_MORE_INFORMATIVE' when q like 'hypo%' then 'LEFT_FUNCTIONALLY_MORE_INFORMATIVE' else 'GENUINE_FUNCTIONAL_DISAGREEMENT' end relation, count(*) loci from x group by all""")
def mt20(spark, sf):
    return mt.tool_pairs(spark.sql(TOOLS, m=load(spark, sf, "sparse_models")))


@query("mt20_tool_hypotheticals", "sparse_models", f"with t as ({TOOLS.format(m='sparse_models')}) select tool, count(*) cds_count, count(*) filter (where product not like '%hypothetical%') specific_annotations, count(*) filter (where product like '%hypothetical%') hypothetical from t group by 1")
def mt20h(spark, sf):
    return mt.tool_hypotheticals(spark.sql(TOOLS, m=load(spark, sf, "sparse_models")))


CALIB = "select case when n_chars > 4000 then 'HIGH' when n_chars > 1500 then 'MEDIUM' when n_chars > 500 then 'LOW' else 'NONE' end confidence, quality = 1 and toxic = 0 correct from {labels} l join {documents} d on l.doc_id = d.doc_id"


@query("mt21_calibration_bins", "", f"""
with c as ({CALIB.format(labels='labels', documents='documents')}), b as (select unnest(['HIGH', 'MEDIUM', 'LOW', 'WEAK', 'NONE']) confidence)
select b.confidence, count(c.confidence) reviewed_n, count(*) filter (where correct) correct_n, round(count(*) filter (where correct) / nullif(count(c.confidence), 0), 6) observed_accuracy, case when count(c.confidence) > 0 then 'MEASURED' else 'NO_REVIEW_DATA' end calibration_status from b left join c using (confidence) group by 1""")
def mt21(spark, sf):
    return rounded(mt.calibration_bins(spark.sql(CALIB, labels=load(spark, sf, "labels"), documents=load(spark, sf, "documents"))))


@query("mt22_start_offsets", "sparse_models", f"""
with {PR}, {RLX}, j as (select p.model_id, p.strand, p.s, p.e, r.s rs, r.e re from rel join pred p on p.model_id = pred_id join refs r on r.model_id = rel.ref_id where mode <> 'AMBIGUOUS'),
 k as (select case when strand = '+' then s - rs else re - e end o, case when strand = '+' then e = re else s = rs end st from j) select o start_offset_nt, st exact_stop, count(*) models from k group by 1, 2""")
def mt22(spark, sf):
    p, r = pred_ref(spark, sf)
    m = mt.relaxed_matches(p, r).where("mode <> 'AMBIGUOUS'")
    pairs = m.join(p.select(F.col("model_id").alias("pred_id"), "strand", "s", "e"), "pred_id").join(r.select(F.col("model_id").alias("ref_id"), F.col("s").alias("rs"), F.col("e").alias("re")), "ref_id")
    return mt.start_offsets(pairs).groupBy("start_offset_nt", "exact_stop").agg(F.count("*").alias("models"))


REVISED = "select genome_id, model_id, case when s % 240 = 1 then s + 30 else s end s, e, strand from {p} where e % 13 <> 0"


@query("mt23_revision_diff", "sparse_models", f"""
with {PR}, a as ({REVISED.format(p='pred')}), t as (select coalesce(p.genome_id, a.genome_id) genome_id, coalesce(p.model_id, a.model_id) model_id, p.s s0, p.e e0, p.strand d0, a.s s1, a.e e1, a.strand d1 from pred p full join a using (model_id)),
 k as (select t.*, x.s is not null h0, y.s is not null h1 from t left join refs x on x.genome_id = t.genome_id and x.s = s0 and x.e = e0 and x.strand = d0 left join refs y on y.genome_id = t.genome_id and y.s = s1 and y.e = e1 and y.strand = d1)
select genome_id, model_id, case when s0 is null then 'ADDED' when s1 is null then 'REMOVED' else 'MOVED' end change, case when s1 is null or s0 is null then null else case when d0 = '+' then e0 else s0 end = case when d1 = '+' then e1 else s1 end end same_stop, h1 and not h0 gained_exact, h0 and not h1 lost_exact
from k where s0 is null or s1 is null or (s0, e0, d0) <> (s1, e1, d1)""")
def mt23(spark, sf):
    p, r = pred_ref(spark, sf)
    return mt.revision_diff(p, spark.sql(REVISED, p=p), r)


GFF = "select model_id, case when e % 17 = 0 then s + 1 else s end s, e, strand from {p}"
ORFT = "select model_id, s, e, case when s % 19 = 0 then '-' else strand end strand from {p} where e % 23 <> 0"


@query("mt24_export_differences", "sparse_models", f"""
with {PR}, g as ({GFF.format(p='pred')}), o as ({ORFT.format(p='pred')}),
 x as (select coalesce(p.model_id, b.model_id) model_id, 'genbank:gff3' exports, p.s ps, b.s bs, p.e pe, b.e be, p.strand pd, b.strand bd from pred p full join g b using (model_id) union all select coalesce(p.model_id, b.model_id), 'genbank:orf_table', p.s, b.s, p.e, b.e, p.strand, b.strand from pred p full join o b using (model_id)),
 l as (select model_id, exports, 's' field, ps::varchar "left", bs::varchar "right" from x union all select model_id, exports, 'e', pe::varchar, be::varchar from x union all select model_id, exports, 'strand', pd, bd from x)
select * from l where "left" is distinct from "right" """)
def mt24(spark, sf):
    p, _ = pred_ref(spark, sf)
    return mt.export_differences({"genbank": p, "gff3": spark.sql(GFF, p=p), "orf_table": spark.sql(ORFT, p=p)}, ["s", "e", "strand"])


@query("mt26_structural_categories", "sparse_models", f"""
with {PR}, o as (select p.model_id, p.strand = r.strand sm, ({OVL}) / least(p.e - p.s + 1, r.e - r.s + 1) sh, case when p.strand = '+' then p.e else p.s end = case when r.strand = '+' then r.e else r.s end st, case when p.strand = '+' then p.s else p.e end = case when r.strand = '+' then r.s else r.e end sa
   from pred p join refs r on p.genome_id = r.genome_id and p.s <= r.e and p.e >= r.s), b as (select model_id, min(case when sm and st and sa then 'A_EXACT' when sm and st then 'B_SAME_STOP' when sm and sa then 'C_SAME_START' when sm and sh >= 0.5 then 'D_SUBSTANTIAL_SAME_STRAND' when sm and sh >= 0.2 then 'E_PARTIAL_SAME_STRAND' when not sm and sh >= 0.5 then 'F_ANTISENSE' else 'I_NO_MEANINGFUL_OVERLAP' end) c from o group by 1)
select genome_id, coalesce(c, case when e - s + 1 < 150 then 'H_SMALL_ORF' else 'G_INTERGENIC' end) category, count(*) predictions from pred left join b using (model_id) group by 1, 2""")
def mt26(spark, sf):
    return mt.structural_categories(*pred_ref(spark, sf))


@query("mt27_match_audit", "sparse_models", f"""
with {PR}, {RLX} select p.model_id pred_id, 'exact' matching_mode, case when ex.pred_id is not null then 'MATCHED' else 'NO_REFERENCE_MATCH' end outcome from pred p left join ex on ex.pred_id = p.model_id
union all select p.model_id, 'relaxed', case when mode = 'AMBIGUOUS' then 'AMBIGUOUS_OVERLAP' when mode is not null then 'MATCHED' else 'NO_REFERENCE_MATCH' end from pred p left join rel on rel.pred_id = p.model_id""")
def mt27(spark, sf):
    return mt.match_audit(*pred_ref(spark, sf))


@query("mt28_caller_counts", "sparse_models", f"""
with {PR}, f as (select genome_id, count(*) n from pred where e % 97 <> 0 group by 1) select p.genome_id, count(*) primary_cds, coalesce(any_value(n), 0) final_cds, count(*) = coalesce(any_value(n), 0) consistent from pred p left join f using (genome_id) group by 1""")
def mt28(spark, sf):
    p, _ = pred_ref(spark, sf)
    return mt.caller_count_invariant(p, p.where("e % 97 <> 0"))


@query("mt29_frozen_counts", "classified", """
with c as (select functional_state metric, count(*) count from classified group by 1), x as (select functional_state metric, count(*) + case when functional_state = 'UNRESOLVED' then 1 else 0 end expected from classified group by 1)
select metric, count, expected from c full join x using (metric) where count is distinct from expected""")
def mt29(spark, sf):
    counts = load(spark, sf, "classified").groupBy(F.col("functional_state").alias("metric")).agg(F.count("*").alias("count"))
    return mt.frozen_counts(counts, counts.withColumn("count", F.expr("count + if(metric = 'UNRESOLVED', 1, 0)")))
