"""Fusion and context queries (FU01-FU22, WN01-WN06)."""

from pyspark.sql import functions as F

from virocohort.functions import sequence as sq
from virocohort.operators import context as cx
from virocohort.operators import fusion as fu
from virocohort.plans.q_evidence import CH, classified_hits, has_sql, norm_sql, sq_list
from virocohort.plans.q_orf import RBS_SQL, STARTS_SQL, two_callers
from virocohort.plans.registry import query
from virocohort.plans.tables import load
from virocohort.rules import fusion as rules

compat = lambda a, b: f"({a} = {b} or contains({a}, {b}) or contains({b}, {a}))"
ACC = f"""{CH}, acc as (select *, {norm_sql('description')} label0 from ch where supports),
 peer as (select distinct protein_id, source, label0 from acc where source <> 'Pfam' and label0 is not null),
 says as (select protein_id, bool_or(coalesce(contains(label0, 'aaa') or contains(label0, 'atpase'), false)) atp, bool_or(coalesce(contains(label0, 'kelch') or contains(label0, 'beta-propeller'), false)) kel from acc group by 1),
 bk as (select hit_id, bool_or({compat('p.label0', 'a.label0')} and p.source <> a.source) backed from acc a join peer p using (protein_id) where a.label0 is not null group by 1),
 cn as (select a.*, coalesce(backed, false) backed, case when contains(label0, 'bcs1') and atp then 'bcs1-like aaa-family atpase' when contains(label0, 'band 7') or contains(label0, 'spfh') then 'band 7/spfh family protein'
     when regexp_matches(label0, '\\bopg\\d+\\b') then case when kel then 'kelch-repeat beta-propeller protein' end when contains(label0, 'mitochondrial') or contains(label0, 'chloroplast') then null else label0 end plain,
   case when contains(label0, 'bcs1') and atp then '{rules.FLAG_BCS1}' when contains(label0, 'band 7') or contains(label0, 'spfh') then '{rules.FLAG_BAND7}'
     when regexp_matches(label0, '\\bopg\\d+\\b') then case when kel then '{rules.FLAG_KELCH}' else '{rules.FLAG_OPG}' end when contains(label0, 'mitochondrial') or contains(label0, 'chloroplast') then '{rules.FLAG_ORGANELLE}' end pflag
   from acc a join says using (protein_id) left join bk using (hit_id)),
 gate as (select *, case when label0 is null then 0 when label0 in ('protein ' || gene, gene || ' protein') then 1 when source = 'Pfam' then 2 when source in ('PHROGs', 'VOGDB') and subject_coverage < 0.5 then 3
     when plain <> label0 then 4 when {has_sql('label0', rules.TAXON_TERMS)} then 5 when source = 'VOGDB' and not ({has_sql('label0', rules.SAFE_TERMS)} or backed) then 6
     when source = 'Swiss-Prot' and not (contains(lower(organism), 'phage') or {has_sql('label0', rules.SAFE_TERMS)} or backed) then 7 else 8 end g from cn),
 cand as (select *, case when g in (4, 8) then plain end lbl, case g when 1 then '{rules.FLAG_SYMBOL}' when 2 then '{rules.FLAG_DOMAIN}' when 3 then '{rules.FLAG_PARTIAL}' when 4 then pflag when 5 then '{rules.FLAG_TAXON}'
     when 6 then '{rules.FLAG_VOG}' when 7 then '{rules.FLAG_SWISS}' when 8 then pflag end flag,
   source = 'Swiss-Prot' and reviewed and contains(lower(organism), 'phage') and evalue <= 1e-20 and ((identity >= 0.4 and query_coverage >= 0.8 and subject_coverage >= 0.8) or (identity >= 0.35 and query_coverage >= 0.9 and subject_coverage >= 0.9)) curated from gate),
 sco as (select *, case source when 'Swiss-Prot' then 50 when 'PHROGs' then 45 when 'VOGDB' then 30 else 10 end + case strength when 'STRONG' then 25 when 'MODERATE' then 12 else 0 end + 20 * least(identity, 1) + 15 * least(query_coverage, 1)
   + least(bits / 50, 12) + case when evalue <= 1e-20 then 8 else 0 end + case when {has_sql('lbl', rules.SAFE_TERMS)} then 8 else 0 end score from cand)"""


@query("fu01_product_candidates", "hits", f"with {ACC} select hit_id, lbl label, flag from cand")
def fu01(spark, sf):
    return fu.product_candidates(fu.accepted_hits(classified_hits(spark, sf))).select("hit_id", "label", "flag")


@query("fu02_corroboration", "hits", f"with {ACC} select hit_id, backed from cn where label0 is not null")
def fu02(spark, sf):
    return fu.accepted_hits(classified_hits(spark, sf)).where("label0 is not null").select("hit_id", fu.corroborated().alias("backed"))


@query("fu03_conservative_label", "hits", f"with {ACC} select hit_id, plain label, pflag flag from cn where label0 is not null")
def fu03(spark, sf):
    label, flag = fu.conservative()
    return fu.accepted_hits(classified_hits(spark, sf)).where("label0 is not null").select("hit_id", label.alias("label"), flag.alias("flag"))


@query("fu04_curated_anchor", "hits", f"with {ACC} select hit_id, curated from cand where source = 'Swiss-Prot'")
def fu04(spark, sf):
    curated, _ = fu.anchors()
    return fu.complete(classified_hits(spark, sf)).where("supports and source = 'Swiss-Prot'").select("hit_id", curated.alias("curated"))


@query("fu05_candidate_score", "hits", f"with {ACC} select hit_id, round(score::double, 6) score from sco where lbl is not null")
def fu05(spark, sf):
    return fu.product_candidates(fu.accepted_hits(classified_hits(spark, sf))).where("label is not null").select("hit_id", F.round("score", 6).alias("score"))


SEL = f"""{ACC}, info as (select * from sco where lbl is not null), rk as (select *, row_number() over (partition by protein_id order by score desc, lbl, hit_id) rn from info),
 top as (select protein_id, lbl tl, score ts, hit_id th from rk where rn = 1),
 cur as (select protein_id, count(distinct lbl) nl, min(lbl) cl from info where curated group by 1),
 srcbest as (select * from info where strength = 'STRONG' qualify row_number() over (partition by protein_id, lbl, source order by score desc, hit_id) = 1),
 vote as (select protein_id, lbl, count(*) n, max(score) + 4 * (count(*) - 1) ag from srcbest group by 1, 2 having count(*) >= 2 and max(query_coverage) >= 0.8),
 vr as (select *, row_number() over (partition by protein_id order by n desc, ag desc, lbl) vn from vote),
 con as (select a.protein_id, a.lbl conl from vr a left join vr b on a.protein_id = b.protein_id and b.vn = 2 where a.vn = 1 and (b.vn is null or a.n > b.n or a.ag - b.ag >= 8)),
 oth as (select i.protein_id, max(score) rs, bool_and({compat('i.lbl', 't.tl')}) fits from info i join top t using (protein_id) where i.lbl <> t.tl group by 1),
 pick as (select t.protein_id, coalesce(nl, 0) nl, case when nl = 1 then cl when nl > 1 then null when conl is not null then conl when coalesce(fits, true) or ts - rs >= 8 then tl end product,
   case when nl > 1 then 'CURATED_DISAGREEMENT' when nl = 1 then 'CURATED_ANCHOR' when conl is not null then 'CONSENSUS' when coalesce(fits, true) or ts - rs >= 8 then 'TOP_RANKED' else 'ABSTAINED' end basis
   from top t left join cur using (protein_id) left join con using (protein_id) left join oth using (protein_id))"""


def gathered(spark, sf):
    return fu.gather(fu.product_candidates(fu.accepted_hits(classified_hits(spark, sf))))


@query("fu06_product_selection", "hits", f"with {SEL} select protein_id, product, basis from pick")
def fu06(spark, sf):
    return fu.select_products(gathered(spark, sf)).where("size(ls) > 0").select("protein_id", "product", "basis")


DIAG = f"""{ACC}, dg as (select protein_id, bool_or(coalesce(source = 'Pfam' and contains(label0, 'dna polymerase family a'), false)) pol, bool_or(coalesce(source = 'Pfam' and contains(label0, 'helix-turn-helix'), false)) hth,
   bool_or(coalesce(source = 'PHROGs' and contains(label0, 'excisionase') and contains(label0, 'transcriptional regulator'), false)) exc, bool_or(coalesce(contains(category, 'integration and excision'), false)) cat, bool_or(coalesce(contains(label0, 'transcriptional regulator'), false)) reg from acc group by 1),
 diag as (select protein_id, case when pol then 'family-a dna polymerase' when hth and exc and cat then 'excisionase and transcriptional regulator' when hth and reg then 'helix-turn-helix transcriptional regulator' end diagnostic_product from dg)"""


@query("fu07_diagnostic_rules", "hits", f"with {DIAG} select * from diag where diagnostic_product is not null")
def fu07(spark, sf):
    return fu.protein_facts(gathered(spark, sf)).where("diagnostic_product is not null").select("protein_id", "diagnostic_product")


DOM = f"""{ACC}, nt as (select protein_id, case when {has_sql('label0', rules.TAXON_TERMS)} then 'domain ' || identifier else label0 end note, min(hit_id) h from acc where source = 'Pfam' and label0 is not null group by 1, 2),
 dn as (select *, row_number() over (partition by protein_id order by h) rn from nt), dom as (select protein_id, 'Detected domain evidence: ' || string_agg(note, ' and ' order by rn) domain_summary from dn where rn <= 2 group by 1)"""


@query("fu09_domain_summary", "hits", f"with {DOM} select * from dom")
def fu09(spark, sf):
    return fu.protein_facts(gathered(spark, sf)).where("domain_summary is not null").select("protein_id", "domain_summary")


@query("fu10_conservation", "hits", f"with {CH} select protein_id, case when bool_or(strength = 'STRONG') then 'STRONGLY_CONSERVED' else 'CONSERVED' end conservation_status from ch where supports and source in ('PHROGs', 'VOGDB') group by 1")
def fu10(spark, sf):
    return fu.protein_facts(gathered(spark, sf)).where("conservation_status <> 'NOT_ESTABLISHED'").select("protein_id", "conservation_status")


grp = [f"bool_or({has_sql('lbl', g)})::int" for g in rules.INCOMPATIBLE_GROUPS]
FULL = f"""{SEL}, {DIAG[len(ACC) + 2:]}, {DOM[len(ACC) + 2:]},
 sl as (select distinct protein_id, lbl from info where strength = 'STRONG'), sg as (select protein_id, count(distinct lbl) nsl, {' + '.join(grp)} >= 2 inc from sl group by 1),
 ss as (select protein_id, count(distinct source) nss, bool_or(source = 'Swiss-Prot') sw, count(distinct case source when 'PHROGs' then 'P' when 'VOGDB' then 'V' when 'Swiss-Prot' then 'S' else source end) nfam, bool_and(source in ('PHROGs', 'VOGDB')) orth from info where strength = 'STRONG' group by 1),
 ag as (select a.protein_id, bool_and({compat('a.lbl', 'b.lbl')}) agree from sl a join sl b using (protein_id) group by 1),
 rw as (select protein_id, count(distinct lbl) nrw, min(lbl) rwl from info where flag is not null and lbl <> label0 group by 1),
 pr as (select protein_id, bool_or(source = 'Pfam') has_domain, count(distinct case when category <> 'unknown' then category end) ncat, bool_or(flag is not null) flagged, string_agg(distinct source, ';' order by source) supporting_sources,
    bool_or(source in ('PHROGs', 'VOGDB')) cons from cand group by 1),
 j as (select *, coalesce(nl, 0) > 1 dis, coalesce(basis = 'CURATED_ANCHOR', false) anch, coalesce(nsl, 0) k, coalesce(nss, 0) m from pr left join pick using (protein_id) left join sg using (protein_id) left join ss using (protein_id) left join ag using (protein_id) left join rw using (protein_id) left join diag using (protein_id)),
 j2 as (select *, (k > 1 and m > 1 and coalesce(inc, false)) or dis clash, k > 1 and not agree and not inc unclear, case when not anch and not dis then diagnostic_product end dp from j),
 j3 as (select *, case when nrw = 1 and not anch and not dis then rwl when dp is not null then dp when not clash then product end final, flagged or unclear or dis or dp is not null ambiguous from j2),
 sup as (select protein_id, lbl, count(distinct source) ns, count(*) nr from info group by 1, 2),
 j4 as (select j3.*, coalesce(ns, 0) ns, coalesce(nr, 0) nr from j3 left join sup on j3.protein_id = sup.protein_id and j3.final = sup.lbl),
 j5 as (select *, case when clash and dp is null then 'CONFLICTING_EVIDENCE' when k >= 1 and (m >= 2 or (sw and ns >= 2)) and nfam >= 2 and not orth and not ambiguous then 'KNOWN_FUNCTION' when final is not null then 'PROBABLE_FUNCTION'
   when ncat > 0 or has_domain then 'FUNCTIONAL_CLASS_ONLY' when cons then 'CONSERVED_UNKNOWN' else 'UNRESOLVED' end functional_state from j4),
 fin as (select protein_id, functional_state, case when functional_state = 'KNOWN_FUNCTION' then 'HIGH' when functional_state = 'PROBABLE_FUNCTION' then case when dp = 'helix-turn-helix transcriptional regulator' then 'LOW' when k > 0 or dp is not null then 'MODERATE' else 'LOW' end
     when functional_state = 'UNRESOLVED' then 'NONE' else 'LOW' end confidence, final proposed_function, coalesce(final, case when cons then 'conserved phage protein of unknown function' else 'hypothetical protein' end) display_product,
   case when functional_state = 'KNOWN_FUNCTION' then 2 when functional_state = 'PROBABLE_FUNCTION' and ns >= 2 then 3 when functional_state in ('PROBABLE_FUNCTION', 'FUNCTIONAL_CLASS_ONLY') then 4 when functional_state = 'CONSERVED_UNKNOWN' then 5 else 6 end evidence_tier,
   case when functional_state in ('CONFLICTING_EVIDENCE', 'UNRESOLVED') or unclear then 'REVIEW_REQUIRED' else 'NONE' end review_flag, supporting_sources, ns::bigint product_supporting_source_count, nr::bigint product_supporting_record_count, clash conflict from j5)"""


@query("fu12_functional_classification", "hits", f"with {FULL} select * from fin")
def fu12(spark, sf):
    return fu.classify(classified_hits(spark, sf)).select(
        "protein_id", "functional_state", "confidence", "proposed_function", "display_product", "evidence_tier", "review_flag", "supporting_sources",
        "product_supporting_source_count", "product_supporting_record_count", "conflict")


@query("fu11_conflict_detection", "hits", f"with {FULL} select protein_id, functional_state from fin where conflict")
def fu11(spark, sf):
    return fu.classify(classified_hits(spark, sf)).where("conflict").select("protein_id", "functional_state")


@query("fu08_gene_transfer", "hits", f"""with {FULL}, g as (select i.protein_id, min(gene) a, max(gene) b from info i join fin f on f.protein_id = i.protein_id and f.proposed_function = i.lbl where i.lbl = i.label0 and strength = 'STRONG' group by 1)
 select protein_id, a gene from g where a = b""")
def fu08(spark, sf):
    return fu.classify(classified_hits(spark, sf)).where("gene is not null").select("protein_id", "gene")


def contextual(spark, sf):
    """Classified genes with the columns the tail-neighbourhood rule reads."""
    return load(spark, sf, "classified").select(
        "*", F.lit(None).cast("string").alias("functional_category"), F.expr("case when functional_state in ('CONSERVED_UNKNOWN', 'FUNCTIONAL_CLASS_ONLY') then 'CONSERVED' else 'NOT_ESTABLISHED' end").alias("conservation_status"),
        F.expr("case when e % 2 = 0 then 'minor tail protein=60.000' else '' end").alias("alternatives"))


@query("fu13_tail_upgrade", "classified", """
with recursive o as (select *, row_number() over (partition by genome_id order by s, e, protein_id) i, coalesce(contains(proposed_function, 'tail'), false) tail,
   proposed_function is null and functional_state in ('CONSERVED_UNKNOWN', 'FUNCTIONAL_CLASS_ONLY') and (e % 2 = 0 or functional_state = 'CONSERVED_UNKNOWN') op from classified),
 n as (select *, coalesce(lead(tail) over w, false)::int + coalesce(lead(tail, 2) over w, false)::int ahead, coalesce(lag(tail) over w, false)::int b1, coalesce(lag(tail, 2) over w, false)::int b2 from o window w as (partition by genome_id order by i)),
 walk as (select genome_id, i, (op and ahead + b1 + b2 >= 2)::int u, 0 pu from n where i = 1
   union all select n.genome_id, n.i, (n.op and n.ahead + greatest(n.b1, w.u) + greatest(n.b2, w.pu) >= 2)::int, w.u from walk w join n on n.genome_id = w.genome_id and n.i = w.i + 1)
select n.protein_id, case when e % 2 = 0 then 'putative minor tail protein' else 'putative tail-associated protein' end proposed_function from walk join n using (genome_id, i) where u = 1""")
def fu13(spark, sf):
    return fu.upgrade_tail_neighbours(contextual(spark, sf)).where("context_upgraded").select("protein_id", "proposed_function")


@query("fu14_attach_gene_calls", "classified", """
select protein_id, functional_state, 'NONE' functional_review_flag, case when e % 3 = 0 then 'HIGH' when e % 3 = 1 then 'LOW' else 'NOT_ASSESSED' end gene_call_confidence, case when e % 3 = 0 then 'NONE' when e % 3 = 1 then 'REVIEW_STRAND' else 'NOT_ASSESSED' end gene_call_review_flag from classified""")
def fu14(spark, sf):
    c = load(spark, sf, "classified").withColumn("review_flag", F.lit(None).cast("string"))
    a = c.where("e % 3 < 2").select("protein_id", F.expr("if(e % 3 = 0, 'HIGH', 'LOW')").alias("gene_call_confidence"), F.expr("if(e % 3 = 0, 'NONE', 'REVIEW_STRAND')").alias("review_flag"))
    return fu.attach_gene_calls(c, a).select("protein_id", "functional_state", "functional_review_flag", "gene_call_confidence", "gene_call_review_flag")


LOCUS_EV = """select protein_id locus_id, case when bits < 40 then 'REJECTED' when bits > 180 and identity < 0.5 then 'CONFLICTING' else 'ACCEPTED' end status, case when evalue <= 1e-20 then 'STRONG' else 'WEAK' end strength,
  case source when 'Pfam' then 'domain' when 'Swiss-Prot' then 'sequence_similarity' else 'orthology' end evidence_type, cast(null as varchar(9)) as role, source from {hits}"""


@query("fu15_functional_adjudication", "hits proteins", f"""
with e as ({LOCUS_EV.format(hits='hits')}), t as (select *, status = 'ACCEPTED' and strength = 'STRONG' ok from e),
a as (select locus_id, count(*) filter (where ok) accepted, count(*) filter (where status = 'ACCEPTED' and not ok) weak, count(*) filter (where status = 'REJECTED') rejected, count(*) filter (where status = 'CONFLICTING') conflicting,
  bool_or(ok and evidence_type = 'domain') dom, bool_or(ok and evidence_type = 'sequence_similarity') whole, bool_and(not ok or evidence_type = 'orthology') fam from t group by 1),
l as (select protein_id locus_id, case when n % 5 = 0 then 'hypothetical protein' when n % 7 = 0 then null else 'portal protein' end product, case when n % 2 = 0 then 'HIGH' else 'LOW' end sc from proteins),
c as (select locus_id, case when coalesce(conflicting, 0) > 0 and coalesce(accepted, 0) = 0 then 'CONFLICTING' when product is null or product like 'hypo%' then 'HYPOTHETICAL' when accepted > 0 and dom and not whole then 'DOMAIN_ONLY' when accepted > 0 and fam then 'SUPPORTED_SPECIFIC'
  when accepted > 0 and sc = 'HIGH' then 'HIGH_CONFIDENCE_SPECIFIC' when accepted > 0 then 'SUPPORTED_SPECIFIC' when weak > 0 then 'SUPPORTED_GENERAL' else 'CONSERVED_UNKNOWN' end functional_class, coalesce(accepted, 0) accepted, coalesce(weak, 0) weak, coalesce(rejected, 0) rejected, coalesce(conflicting, 0) conflicting from l left join a using (locus_id))
select *, case functional_class when 'HIGH_CONFIDENCE_SPECIFIC' then 'HIGH' when 'SUPPORTED_SPECIFIC' then 'MODERATE' else 'LOW' end assignment_confidence from c""")
def fu15(spark, sf):
    loci = load(spark, sf, "proteins").select(F.col("protein_id").alias("locus_id"), F.expr("case when n % 5 = 0 then 'hypothetical protein' when n % 7 = 0 then null else 'portal protein' end").alias("product"),
                                              F.expr("if(n % 2 = 0, 'HIGH', 'LOW')").alias("structural_confidence"))
    return fu.adjudicate_function(spark.sql(LOCUS_EV, hits=load(spark, sf, "hits")), loci)


@query("fu16_structural_adjudication", "hits", """
with a as (select protein_id, count(*) n, bool_or(evalue <= 1e-20) st, bool_or(source <> 'Pfam') ind, case count(*) % 4 when 0 then 'EXACT_MATCH' when 1 then 'PHANOTATE_ONLY' when 2 then 'CONFLICTING_ORF' else 'NEAR_BOUNDARY_MATCH' end rel from hits group by 1)
select protein_id, case when rel = 'EXACT_MATCH' then 'HIGH' when st and (ind or n >= 2) then 'MODERATE' when rel = 'PHANOTATE_ONLY' and n = 0 then 'UNRESOLVED' else 'LOW' end confidence from a""")
def fu16(spark, sf):
    a = load(spark, sf, "hits").groupBy("protein_id").agg(F.count("*").alias("n"), F.bool_or(F.col("evalue") <= 1e-20).alias("st"), F.bool_or(F.col("source") != "Pfam").alias("ind"))
    rel = F.expr("element_at(array('EXACT_MATCH', 'PHANOTATE_ONLY', 'CONFLICTING_ORF', 'NEAR_BOUNDARY_MATCH'), cast(1 + n % 4 as int))")
    return a.select("protein_id", fu.adjudicate_structure(rel, F.col("n"), F.col("st"), F.col("ind")).alias("confidence"))


MODULE_EV = """select p.genome_id, h.protein_id locus_id, case when contains(description, 'apsid') then 'HEAD CAPSID' when contains(description, 'tail') then 'TAIL' when contains(description, 'terminase') then 'DNA_PACKAGING' when contains(description, 'helicase') then 'DNA REPLICATION'
  when contains(description, 'integrase') then 'INTEGRATION' when contains(description, 'regulator') then 'REGULATION' when contains(description, 'endolysin') then 'LYSIS' else 'NONE' end as label,
  case when identity < 0.4 then 'CONFLICT' else 'SUPPORT' end as role, case when evalue <= 1e-20 then 'STRONG' else 'WEAK' end strength, h.source from {hits} h join {proteins} p on h.protein_id = p.protein_id"""
MODS = f"""me as ({MODULE_EV.format(hits='hits', proteins='proteins')}), mk as (select * from (values {', '.join(f"('{m}')" for m in rules.EVIDENCE_MODULES)}) t(module)),
 ma as (select genome_id, module, count(*) filter (where role = 'SUPPORT' and strength = 'STRONG') q, count(*) filter (where role = 'SUPPORT') n, count(*) filter (where role = 'CONFLICT') c, count(distinct source) filter (where role = 'SUPPORT' and strength = 'STRONG') sr
   from me join mk on contains(label, module) or contains(label, replace(module, '_', ' ')) group by 1, 2),
 mo as (select genome_id, module, case when coalesce(c, 0) > 0 and q = 0 then 'EVIDENCE_PRESENT_REVIEW_REQUIRED' when sr >= 2 then 'STRONGLY_SUPPORTED' when q > 0 then 'SUPPORTED' when n > 0 then 'CANDIDATE' else 'NOT_ESTABLISHED' end status,
   coalesce(q, 0) qualified_evidence_count, coalesce(n, 0) evidence_count, coalesce(c, 0) conflicting_evidence_count from (select distinct genome_id from me) cross join mk left join ma using (genome_id, module))"""


def module_rows(spark, sf):
    return fu.module_evidence(spark.sql(MODULE_EV, hits=load(spark, sf, "hits"), proteins=load(spark, sf, "proteins")))


@query("fu17_module_evidence", "hits proteins", f"with {MODS} select * from mo")
def fu17(spark, sf):
    return module_rows(spark, sf)


ARCH = f"""{MODS}, up as (select *, status in ('STRONGLY_SUPPORTED', 'SUPPORTED') u from mo),
 sc as (select genome_id, case when bool_or(u and module in ('TAIL', 'BASEPLATE', 'PORTAL')) then 2 else 0 end t, count(*) filter (where u and module in {sq_list(rules.FILAMENTOUS_MODULES)}) f0,
   (bool_or(u and module = 'DNA_REPLICATION') and not bool_or(u and module in ('PORTAL', 'TAIL')))::int s, bool_or(status = 'STRONGLY_SUPPORTED' and module in ('TAIL', 'PORTAL', 'HEAD_CAPSID')) ts from up group by 1),
 s2 as (select *, case when f0 >= 2 then f0 else 0 end f from sc), ar as (select genome_id, case when greatest(t, f, s) = 0 then 'ARCHITECTURE_UNRESOLVED' when (t = greatest(t, f, s))::int + (f = greatest(t, f, s))::int + (s = greatest(t, f, s))::int > 1 then 'MIXED_OR_CONFLICTING'
   when ts and f0 >= 2 then 'MIXED_OR_CONFLICTING' when t = greatest(t, f, s) then 'TAILED_DSDNA_LIKE' when f = greatest(t, f, s) then 'FILAMENTOUS_PHAGE_LIKE' else 'SMALL_SSDNA_PHAGE_LIKE' end architecture, t::bigint tailed_score, f::bigint filamentous_score, s::bigint small_score from s2)"""


@query("fu18_architecture", "hits proteins", f"with {ARCH} select * from ar")
def fu18(spark, sf):
    return fu.architecture(module_rows(spark, sf))


hall = " union all ".join(f"select '{a}' architecture, unnest([{', '.join(repr(x) for x in v)}]) hallmark" for a, v in rules.ARCHITECTURE_HALLMARKS.items())


@query("fu18_architecture_hallmarks", "hits proteins", f"""with {ARCH}, hl as ({hall}) select genome_id, architecture, hallmark, case when architecture = 'FILAMENTOUS_PHAGE_LIKE' and hallmark in {sq_list(rules.NOT_FILAMENTOUS)} then 'NOT_APPLICABLE_TO_ARCHITECTURE' else status end status
 from ar join hl using (architecture) join mo on mo.genome_id = ar.genome_id and mo.module = hallmark""".replace("select genome_id, architecture, hallmark, case", "select ar.genome_id, architecture, hallmark, case"))
def fu18h(spark, sf):
    m = module_rows(spark, sf)
    return fu.architecture_hallmarks(fu.architecture(m), m)


COMP = "select {id} id, case when l_quantity > 45 then null else l_discount * 10 end distance, cast(case when l_linenumber = 1 then 0 else l_linenumber end as bigint) hashes, case when l_tax > 0.05 then null else l_tax * 18 end cons, case when l_tax > 0.07 then null else l_tax * 10 end share, case when l_returnflag = 'A' then null else l_returnflag = 'R' end sig, l_linestatus = 'F' ready from {lineitem}"
COMP_ID = "concat(cast(l_orderkey as varchar(20)), '_', cast(l_linenumber as varchar(9)), '_', cast(l_partkey as varchar(20)), '_', cast(l_suppkey as varchar(20)), '_', cast(cast(l_quantity as int) as varchar(9)), '_', substr(cast(l_shipdate as varchar(30)), 1, 10))"


@query("fu19_comparative_state", "", f"""
with c as ({COMP.format(id=COMP_ID, lineitem='lineitem')}) select id, case when not ready then 'DATABASE_UNAVAILABLE' when coalesce(not sig, false) or (coalesce(hashes = 0 or distance = 1, false) and not coalesce(cons >= 0.25, false)) then 'NO_SIGNIFICANT_REFERENCE'
 when sig is null and cons is null and share is null then 'INSUFFICIENT_DATA' when greatest(coalesce(cons, 0), coalesce(share, 0)) >= 0.7 then 'SIGNIFICANT_CLOSE_REFERENCE' when greatest(coalesce(cons, 0), coalesce(share, 0)) >= 0.25 then 'SIGNIFICANT_DISTANT_REFERENCE' else 'WEAK_REFERENCE' end state from c""")
def fu19(spark, sf):
    c = spark.sql(COMP.replace("{id}", COMP_ID), lineitem=load(spark, sf, "lineitem"))
    return c.select("id", fu.comparative_state(*[F.col(x) for x in ("distance", "hashes", "cons", "share", "sig", "ready")]).alias("state"))


@query("fu20_cds_confidence", "contigs", f"""
with {STARTS_SQL}, pw as (select p.*, substr(st, (greatest(0, lft - 20) + 1)::bigint, greatest(0, lft - 4 - greatest(0, lft - 20))::bigint) win from prim2 p join strands using (genome_id, strand)), {RBS_SQL.format('pw')},
 x as (select pw.*, coalesce(rbs_score, 0) r, exists (select 1 from sec where sec.genome_id = pw.genome_id and sec.strand = pw.strand and sec.rgt = pw.rgt) both_c, s % 11 = 0 sup from pw left join rbs using (win))
select genome_id, model_id, case when not both_c and e - s + 1 < 150 and r < 8 and not sup then 'low' when both_c or sup then 'high' else 'medium' end confidence_tier, case when both_c then 'Both' else 'Primary' end caller_support,
 not both_c and e - s + 1 < 150 single_caller_micro_orf, not both_c and e - s + 1 < 150 and r < 8 and not sup excluded from x""")
def fu20(spark, sf):
    primary, secondary = two_callers(spark, sf)
    contigs = load(spark, sf, "contigs")
    m = primary.join(contigs, "genome_id")
    left, _ = sq.oriented(F.col("s"), F.col("e"), F.col("strand"), F.length("seq"))
    window = sq.rbs_window(sq.StrandView(F.col("seq"), F.length("seq"), F.col("strand")), left)
    m = m.select("genome_id", "model_id", "s", "e", "strand", F.lit(False).alias("rescue"), window.alias("w")).withColumn("rbs_score", sq.rbs(F.col("w"))["score"]).drop("w")
    return fu.cds_confidence(m, secondary, primary.where("s % 11 = 0").select("model_id"), strict=True)


INTEREST = f"""{CH}, iv as (select p.protein_id, p.genome_id, p.e - p.s + 1 - 199 len, bool_or(source = 'Pfam' and strength = 'STRONG') dom, coalesce(bool_or(supports and strength in ('STRONG', 'EXPERIMENTAL')), false) strong, count(distinct source) filter (where supports) mods from proteins p left join ch using (protein_id) group by all),
 io as (select *, coalesce(mods, 0) <= 3 unk from iv), ip as (select *, greatest(0, least(100, case when unk and dom then 12 else 0 end + case when unk then least(16, greatest(0, mods - 1) * 4) else 0 end - case when len < 40 then 15 else 0 end))::bigint interest,
  case when mods >= 4 then 'High' when mods >= 2 then 'Moderate' when mods >= 1 then 'Low' else 'None' end diversity from io)"""


def interests(spark, sf):
    h = classified_hits(spark, sf).groupBy("protein_id").agg(F.bool_or(F.expr("source = 'Pfam' and strength = 'STRONG'")).alias("dom"), F.bool_or(F.expr("supports and strength in ('STRONG', 'EXPERIMENTAL')")).alias("strong"), F.count_distinct(F.expr("if(supports, source, null)")).alias("mods"))
    p = load(spark, sf, "proteins").join(h, "protein_id", "left").withColumn("mods", F.coalesce("mods", F.lit(0)))
    score, diversity = fu.interest_score(F.col("mods") <= 3, F.coalesce("dom", F.lit(False)), F.col("mods"), F.col("e") - F.col("s") + 1 - 199)
    return p.select("protein_id", "genome_id", F.coalesce("strong", F.lit(False)).alias("strong"), score.alias("interest"), diversity.alias("diversity"), (F.col("mods") <= 3).alias("unknown"))


@query("fu21_interest_score", "hits proteins", f"with {INTEREST} select protein_id, interest, diversity from ip")
def fu21(spark, sf):
    return interests(spark, sf).select("protein_id", "interest", "diversity")


@query("fu22_candidate_ranking", "hits proteins", f"""
with {INTEREST}, c as (select *, bool_or(strong) over (partition by genome_id) sure from ip where unk)
select genome_id, protein_id, interest, case when sure then row_number() over (partition by genome_id order by interest desc, protein_id) end rank, case when sure then 'RANKED' else 'INSUFFICIENT_EVIDENCE' end ranking_status from c""")
def fu22(spark, sf):
    return fu.rank_candidates(interests(spark, sf).where("unknown"))


@query("wn01_gene_order", "proteins", """
select protein_id, row_number() over w - 1 gene_order_index, lag(protein_id) over w upstream_id, lead(protein_id) over w downstream_id, s - lag(e) over w - 1 upstream_distance, lead(s) over w - e - 1 downstream_distance
from proteins window w as (partition by genome_id order by s, e, protein_id)""")
def wn01(spark, sf):
    return cx.gene_order(load(spark, sf, "proteins")).select("protein_id", "gene_order_index", "upstream_id", "downstream_id", "upstream_distance", "downstream_distance")


@query("wn02_neighbours", "proteins", """
with o as (select *, row_number() over (partition by genome_id order by s, e, protein_id) i from proteins)
select a.protein_id, coalesce(string_agg(b.protein_id, ';' order by b.i), '') neighbours from o a left join o b on a.genome_id = b.genome_id and a.i <> b.i and abs(a.i - b.i) <= 2 group by 1""")
def wn02(spark, sf):
    return cx.neighbours(load(spark, sf, "proteins")).select("protein_id", "neighbours")


SIG = f"""tx as (select *, coalesce(proposed_function, '') t, row_number() over (partition by genome_id order by s, e, protein_id) - 1 idx from classified),
 sg as (select *, list_filter([{', '.join(f"case when {has_sql('t', w)} then '{k}' end" for k, w in rules.MODULES.items())}], lambda x: x is not null) ms from tx),
 sn as (select * exclude (ms), case when len(ms) = 1 then ms[1] end signal from sg),
 an as (select *, lag(signal) over (partition by genome_id order by idx) pv from sn where signal is not null), isl as (select *, sum(case when pv = signal then 0 else 1 end) over (partition by genome_id order by idx) island from an),
 seg as (select genome_id, signal functional_module, count(*) anchors, min(idx) first_idx, max(idx) last_idx, 'module_' || signal || '_' || arg_min(s, idx) || '_' || arg_max(e, idx) module_id from isl group by genome_id, island, signal having count(*) >= 2)"""


def signal_genes(spark, sf):
    return load(spark, sf, "classified").withColumn("functional_category", F.lit(None).cast("string"))


@query("wn03_modules", "classified", f"with {SIG} select * from seg")
def wn03(spark, sf):
    return cx.module_members(signal_genes(spark, sf))[1].select("genome_id", "functional_module", "anchors", "first_idx", "last_idx", "module_id")


@query("wn04_segment_overlaps", "classified", f"with {SIG} select a.genome_id, a.module_id module_id_a, b.module_id module_id_b from seg a join seg b on a.genome_id = b.genome_id and a.module_id < b.module_id and a.first_idx <= b.last_idx and a.last_idx >= b.first_idx")
def wn04(spark, sf):
    return cx.overlapping_segments(cx.module_members(signal_genes(spark, sf))[1]).select("genome_id", "module_id_a", "module_id_b")


@query("wn05_local_ambiguity", "classified", f"""
with {SIG}, nb as (select a.protein_id, count(distinct b.signal) ns from sn a join sn b on a.genome_id = b.genome_id and abs(a.idx - b.idx) <= 2 group by 1)
select n.genome_id, n.protein_id, n.signal, module_id, functional_module, ns > 1 and module_id is null ambiguous_module_boundary, case when module_id is not null then 'HIGH' when ns > 1 then 'LOW' else 'NONE' end context_confidence
from sn n join nb using (protein_id) left join seg on seg.genome_id = n.genome_id and n.idx between first_idx and last_idx""")
def wn05(spark, sf):
    return cx.module_context(signal_genes(spark, sf)).drop("gene_order_index")


@query("wn06_hallmarks", "classified", f"""
with k as (select * from (values {', '.join(f"('{h}', [{', '.join(repr(w) for w in ws)}])" for h, ws in rules.HALLMARKS.items())}) t(hallmark, words)),
c as (select *, coalesce(proposed_function, '') || ' ' || coalesce(domain_summary, '') t, functional_state in ('KNOWN_FUNCTION', 'PROBABLE_FUNCTION') sure, case confidence when 'HIGH' then 1 when 'MODERATE' then 2 else 3 end r from classified),
m as (select c.*, hallmark from c join k on len(list_filter(words, lambda w: contains(c.t, w))) > 0),
a as (select genome_id, hallmark, count(*) n, count(*) filter (where sure) q, min(r) filter (where sure) r1, min(r) r2, min(protein_id) filter (where sure) p1, min(protein_id) p2 from m group by 1, 2)
select genome_id, hallmark, case when q > 0 then 'DETECTED' when n > 0 then 'POSSIBLE_DOMAIN_OR_CATEGORY_SUPPORT' else 'NOT_ESTABLISHED' end status, coalesce(case when q > 0 then q else n end, 0) proteins, coalesce(case when q > 0 then p1 else p2 end, '') first_protein,
 case case when q > 0 then r1 else r2 end when 1 then 'HIGH' when 2 then 'MODERATE' when 3 then 'LOW' else 'NONE' end highest_confidence from (select distinct genome_id from classified) cross join k left join a using (genome_id, hallmark)""")
def wn06(spark, sf):
    return cx.hallmarks(load(spark, sf, "classified"))
