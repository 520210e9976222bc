"""Quality, curation and review queries (QC01-QC15, CU01-CU10, GM08-GM10, TX12)."""

from pyspark.sql import functions as F

from virocohort.functions import sequence as sq
from virocohort.functions.labels import PENDING
from virocohort.operators import curation as cu
from virocohort.operators import fusion as fu
from virocohort.operators import quality as qc
from virocohort.plans.q_evaluation import rounded
from virocohort.plans.q_evidence import CH, classified_hits, inf_sql, prod_sql, sq_list
from virocohort.plans.q_fusion import FULL
from virocohort.plans.q_intervals import PAIRS, SELECTION, decided
from virocohort.plans.q_orf import STARTS, STOPS
from virocohort.plans.q_sequence import CDS_SQL, PROTEIN_SQL, calls_with_cds
from virocohort.operators import reconcile as rc
from virocohort.plans.registry import query
from virocohort.plans.tables import load
from virocohort.session import cut_lineage

# stored genes with planted faults: some coordinates, sequences and translations are wrong
FAULT_S = "case when s % 101 = 0 then s - 2000 when s % 37 = 0 then 1 else s end"
FAULT_CDS = "case when e % 29 = 0 then concat('ATG', substr(cds, 4)) when e % 31 = 0 then 'ATGA' else cds end"
FAULT_P = "case when e % 23 = 0 then concat('Q', protein) else protein end"


def faulty_genes(spark, sf):
    c = calls_with_cds(spark, sf).withColumn("cds", F.expr(FAULT_CDS))
    c = c.withColumn("protein", sq.translate(F.col("cds"))).withColumn("protein", F.expr(FAULT_P))
    return c.select("genome_id", "model_id", F.expr(FAULT_S).alias("s"), "e", "strand", "cds", "protein")


RCX = "translate(reverse({0}), 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')"
BROKEN = f"""c0 as ({CDS_SQL}), c1 as (select * replace ({FAULT_CDS} as cds) from c0), c2 as (select *, {PROTEIN_SQL.format('cds')} tr from c1), c3 as (select * exclude (s), {FAULT_S} s, case when e % 23 = 0 then 'Q' || tr else tr end protein, length(seq) n from c2),
 g as (select *, s >= 1 and s <= e and e <= n ok, case when s >= 1 then case when strand = '-' then {RCX.format('substr(seq, s, e - s + 1)')} else substr(seq, s, e - s + 1) end end obs from c3)"""
QC01_SQL = f"""{BROKEN}, f as (select genome_id, model_id, unnest([case when not ok then 'coordinate_out_of_range' end, case when ok and obs <> cds then 'cds_sequence_mismatch' end, case when ok and length(cds) % 3 <> 0 then 'cds_length_not_multiple_of_three' end,
   case when ok and protein <> tr then 'translation_mismatch' end, case when ok and contains(tr, '*') then 'internal_stop_codon' end, case when ok and (s = 1 or e = n) then 'boundary_adjacent_cds' end, case when ok and length(cds) >= 6 and substr(cds, 1, 3) not in ('ATG', 'GTG', 'TTG') and e <> n then 'noncanonical_start_codon' end,
   case when ok and length(cds) >= 6 and right(cds, 3) not in {STOPS} and s <> 1 then 'missing_terminal_stop_codon' end, case when ok and length(cds) < 6 then 'very_short_cds' end]) code from g),
 fi as (select *, case when code in {sq_list(qc.ERRORS)} then 'error' when code in {sq_list(qc.INFOS)} then 'info' else 'warning' end severity from f where code is not null)"""


@query("qc01_cds_audit", "calls contigs", f"with {QC01_SQL} select * from fi")
def qc01(spark, sf):
    return qc.audit_cds(faulty_genes(spark, sf), load(spark, sf, "contigs"))


@query("qc02_genome_rollup", "calls contigs", f"""with {QC01_SQL}, per as (select genome_id, count(*) filter (where severity = 'error') er, count(*) filter (where severity = 'warning') wa, count(*) filter (where severity = 'info') inf from fi group by 1),
 {PAIRS.format('g')}, k as (select genome_id, case when (sa, ea, da, id_a) <= (sb, eb, db, id_b) then ea else eb end le, case when (sa, ea, da, id_a) <= (sb, eb, db, id_b) then sb else sa end rs from p), ov as (select genome_id, count(*) filter (where rs = le) sh, count(*) filter (where rs <> le) o from k group by 1),
 w as (select *, max(e) over (partition by genome_id order by s, e rows between unbounded preceding and 1 preceding) pe from g where ok), cv as (select genome_id, sum(greatest(0, e - greatest(coalesce(pe, s - 1), s - 1)))::bigint cov from w group by 1), nn as (select genome_id, count(*) predicted_cds from g group by 1),
 j as (select c.genome_id, length(seq)::bigint sequence_length, predicted_cds, cov coding_bases, 100.0 * cov / length(seq) d, coalesce(er, 0) er, coalesce(wa, 0) + coalesce(o, 0) + case when 100.0 * cov / length(seq) < 85 then 1 else 0 end wt, coalesce(inf, 0) + coalesce(sh, 0) it from contigs c join nn using (genome_id) left join per using (genome_id) left join ov using (genome_id) left join cv using (genome_id))
select genome_id, sequence_length, predicted_cds, coding_bases, round(d, 6) coding_density_percent, er errors, wt warnings, it infos, case when er > 0 then 'failed' when wt > 0 then 'review_required' else 'passed' end status from j""")
def qc02(spark, sf):
    g, c = faulty_genes(spark, sf), load(spark, sf, "contigs")
    return rounded(qc.genome_rollup(qc.audit_cds(g, c), g, c))


P5, P3 = "s % 43 = 0", "e % 41 = 0"


def submitted(spark, sf):
    return faulty_genes(spark, sf).select("*", F.expr(P5).alias("partial_5"), F.expr(P3).alias("partial_3"), F.lit(1).alias("codon_start"), F.expr("strand = '+' and e % 53 = 0").alias("mock"))


SUB = f"""{BROKEN}, sb as (select *, {P5} p5, {P3} p3, strand = '+' and e % 53 = 0 mock, case when substr(cds, 1, 3) in {STARTS} and tr <> '' then 'M' || substr(tr, 2) else tr end strict, substr(cds, 1, 3) in {STARTS} st, right(cds, 3) in {STOPS} sp, length(cds) >= 6 lg,
   case when strand = '+' then s = 1 else e = n end b5, case when strand = '+' then e = n else s = 1 end b3 from g)"""
tests = [("not ok", "coordinate_out_of_range", "error"), ("ok and ((p5 and not b5) or (p3 and not b3))", "NCBI_PARTIAL_LOCATION", "error"), ("ok and obs <> cds", "cds_fasta_mismatch", "error"), ("ok and length(cds) % 3 <> 0 and not (p5 or p3)", "NCBI_CDS_FRAME", "error"),
         ("ok and (protein = '' or contains(protein, '*'))", "invalid_translation", "error"), ("ok and protein <> tr and protein <> strict", "translation_mismatch", "error"), ("ok and lg and not st and not p5", "NCBI_CDS_START", "error"), ("ok and lg and not st", "noncanonical_start_codon", "warning"),
         ("ok and lg and not sp and not p3", "NCBI_CDS_NOSTOP", "error"), ("ok and lg and not sp and p3", "NCBI_CDS_NOSTOP", "warning"), ("ok and lg and not sp and not p3 and b3", "POSSIBLE_ORIGIN_CROSSING_CDS", "warning"), ("ok and mock", "mock_or_unsupported_function", "warning")]


@query("qc03_presubmission", "calls contigs", f"with {SUB} " + " union all ".join(f"select genome_id, model_id, '{c}' code, '{s}' severity from sb where {t}" for t, c, s in tests))
def qc03(spark, sf):
    return qc.presubmission(submitted(spark, sf), load(spark, sf, "contigs"))


FACTS = """select genome_id, max(case when s % 7 = 0 then 1 else 0 end) = 1 anomalies, min(s) % 2 = 0 rescue_audit, max(e) % 5 = 0 bad_cds, max(e) % 3 = 0 partial_cds, count(*) % 2 = 0 diverse_evidence, max(s) % 11 = 0 bad_regulatory, count(*) % 3 = 0 missing_metadata,
  min(e) % 13 = 0 bad_tags, min(s) % 17 = 0 bad_products, count(*) % 5 > 0 provenance from {p} group by genome_id"""
warn = lambda c: f"case when {c} then 'WARN' else 'PASS' end"
answers = ["'WARN'", "'WARN'", warn("anomalies"), "'WARN'", warn("not rescue_audit"), "case when bad_cds then 'FAIL' when partial_cds then 'WARN' else 'PASS' end", warn("not diverse_evidence"), "'WARN'", "case when bad_regulatory then 'FAIL' else 'WARN' end", warn("missing_metadata"),
           "case when bad_tags then 'FAIL' else 'WARN' end", "case when bad_products then 'FAIL' else 'PASS' end", "'WARN'", warn("not provenance")]
CHECK = f"fx as ({FACTS.format(p='proteins')}), ck as (" + " union all ".join(f"select genome_id, {i + 1} question, '{q}' criterion, {a} status from fx" for i, (q, a) in enumerate(zip(qc.QUESTIONS, answers))) + ")"


@query("qc04_checklist", "proteins", f"with {CHECK} select * from ck")
def qc04(spark, sf):
    return qc.checklist(spark.sql(FACTS, p=load(spark, sf, "proteins")))


@query("qc04_checklist_status", "proteins", f"with {CHECK} select genome_id, case when bool_or(status = 'FAIL') then 'FAIL' when bool_or(status = 'WARN') then 'WARN' else 'PASS' end status, count(*) filter (where status = 'FAIL') failed, count(*) filter (where status = 'WARN') warned from ck group by 1")
def qc04s(spark, sf):
    return qc.checklist_status(qc.checklist(spark.sql(FACTS, p=load(spark, sf, "proteins"))))


TAGS = "select genome_id, case when s % 97 = 0 then concat('9X-', cast(s as varchar(9))) when s % 53 = 0 then 'PHG_7' else concat('PHG_', cast(i as varchar(9))) end locus_tag from (select *, row_number() over (partition by genome_id order by s, e, protein_id) i from {p}) t"


@query("qc05_locus_tags", "proteins", f"""
with t as ({TAGS.format(p='proteins')}) select genome_id, count(*) filter (where not regexp_full_match(locus_tag, '[A-Za-z][A-Za-z0-9]*_\\d+')) bad_tags, count(*) - count(distinct locus_tag) duplicate_tags,
 max(regexp_extract(locus_tag, '(\\d+)$', 1)::bigint) - min(regexp_extract(locus_tag, '(\\d+)$', 1)::bigint) + 1 = count(*) contiguous from t group by 1""")
def qc05(spark, sf):
    return qc.locus_tags(spark.sql(TAGS, p=load(spark, sf, "proteins")))


MODALITY = "case source when 'Pfam' then 'domain' when 'VOGDB' then 'viral_orthology' when 'PHROGs' then 'phage_orthology' else 'sequence_similarity' end"


@query("qc06_evidence_diversity", "hits", f"""
with {CH} select protein_id, string_agg(distinct source, ';' order by source) sources, bool_or(source in ('PHROGs', 'Swiss-Prot')) and bool_or(source in ('Pfam', 'VOGDB')) sequence_and_profile from ch where supports group by 1""")
def qc06(spark, sf):
    return qc.evidence_diversity(classified_hits(spark, sf).withColumn("modality", F.expr(MODALITY)))


METADATA = "select c_name genome_id, case when c_custkey % 3 = 0 then '' else c_name end organism, c_mktsegment host, case when c_custkey % 4 = 0 then null else 'soil' end isolation_source, case when c_custkey % 5 = 0 then ' ' else 'A' end authors, 'S' submitter_name, case when c_acctbal < 0 then null else 'm' end submitter_email from {c}"


@query("qc07_missing_metadata", "", f"""
with m as ({METADATA.format(c='customer')}), l as (select genome_id, list_filter([case when coalesce(trim(organism), '') = '' then 'organism' end, case when coalesce(trim(host), '') = '' then 'host' end, case when coalesce(trim(isolation_source), '') = '' then 'isolation_source' end, case when coalesce(trim(authors), '') = '' then 'authors' end,
  case when coalesce(trim(submitter_email), '') = '' then 'submitter_email' end], lambda x: x is not null) g from m) select genome_id, array_to_string(g, ';') missing_fields, len(g) missing_count from l""")
def qc07(spark, sf):
    return qc.missing_metadata(spark.sql(METADATA, c=load(spark, sf, "customer")))


@query("qc08_artifact_consistency", "proteins", """
with p as (select protein_id, s % 31 <> 0 a, e % 37 <> 0 b, s % 41 <> 0 c from proteins), x as (select protein_id, list_filter([case when not a then 'annotation' end, case when not b then 'fasta' end, case when not c then 'gff' end], lambda x: x is not null) l from p) select protein_id, array_to_string(l, ';') missing_from from x where len(l) between 1 and 2""")
def qc08(spark, sf):
    p = load(spark, sf, "proteins")
    return qc.artifact_consistency({"annotation": p.where("s % 31 <> 0"), "fasta": p.where("e % 37 <> 0"), "gff": p.where("s % 41 <> 0")})


@query("qc09_codon_verification", "calls contigs", f"""
with {SUB}, t as (select *, {PROTEIN_SQL.format('obs')} plain from sb where ok), full_ as (select sb.genome_id, sb.model_id, sb.ok, coalesce((p5 and not b5) or (p3 and not b3), false) pin from sb),
 r as (select *, {PROTEIN_SQL.replace("regexp_replace(", "(", 1).replace(", '\\*$', '')", ")").format('obs')} raw from t), b as (select *, case when not p3 then regexp_replace(raw, '\\*$', '') else raw end body, substr(obs, 1, 3) in {STARTS} ost, right(obs, 3) in {STOPS} osp from r),
 z as (select genome_id, model_id, concat_ws(';', case when obs <> cds then 'CDS_SEQUENCE_MISMATCH' end, case when not p5 and not ost then 'CDS_START_INVALID' end, case when not p3 and not osp then 'CDS_STOP_MISSING' end, case when length(obs) % 3 <> 0 and not p3 then 'CDS_FRAME_INVALID' end,
   case when contains(body, '*') then 'CDS_INTERNAL_STOP_REVIEW_RECODING' end, case when (case when not p5 and ost and body <> '' then 'M' || substr(body, 2) else body end) <> protein then 'CDS_TRANSLATION_MISMATCH' end) problems from b)
select f.genome_id, f.model_id, coalesce(problems, 'CDS_COORDINATE_INVALID') problems, pin partial_inside, case when problems = '' and not pin then 'PASS' else 'FAIL' end status from full_ f left join z using (genome_id, model_id)""")
def qc09(spark, sf):
    return qc.codon_verification(submitted(spark, sf), load(spark, sf, "contigs"))


@query("qc10_reference_qc", "members", """
with p as (select n % 5 = 0 mm, n % 5 <> 0 and n % 7 = 0 md, n % 3 = 0 u from members) select 'total_proteins' metric, count(*) "value", 'OK' status from p union all select 'missing_mapping', count(*) filter (where mm), case when count(*) filter (where mm) > 0 then 'REVIEW' else 'OK' end from p
union all select 'missing_metadata', count(*) filter (where md), case when count(*) filter (where md) > 0 then 'REVIEW' else 'OK' end from p union all select 'predicted_uncharacterized', count(*) filter (where u), 'OK' from p""")
def qc10(spark, sf):
    p = load(spark, sf, "members").select(F.expr("n % 5 = 0").alias("missing_mapping"), F.expr("n % 5 <> 0 and n % 7 = 0").alias("missing_metadata"), F.expr("if(n % 3 = 0, 'PREDICTED_UNCHARACTERIZED', 'PREDICTED_FUNCTION')").alias("annotation_state"))
    return qc.reference_qc(p)


RNA = "select genome_id seqid, case when e % 9 = 0 then 'CDS' when e % 2 = 0 then 'tRNA' else 'tmRNA' end as type, s, case when e % 19 = 0 then e + 4000 else e end e, case when s % 17 = 0 then '?' else strand end strand, case when e % 7 = 0 then '' else 'tRNA-Ala' end product, 'scan' source from {c}"


@query("qc11_rna_features", "calls contigs", f"""
with r as ({RNA.format(c='calls')}), d as (select *, count(*) over (partition by seqid, "type", s, e, strand) n from r)
select seqid, "type", s, e, strand, product, 'PM_RNA_' || substr(sha256(concat_ws('|', seqid, "type", s, e, strand)), 1, 12) feature_id, concat_ws(';', case when "type" = 'CDS' then 'UNSUPPORTED_TYPE' end, case when e > 2048 then 'OUT_OF_BOUNDS' end, case when strand = '?' then 'BAD_STRAND' end, case when n > 1 then 'DUPLICATE' end, case when product = '' then 'NO_PROVENANCE' end) problems from d""")
def qc11(spark, sf):
    lengths = load(spark, sf, "contigs").select("genome_id", F.length("seq").alias("genome_length"))
    return qc.rna_features(spark.sql(RNA, c=load(spark, sf, "calls")), lengths)


@query("qc12_uniqueness_gate", "", "select l_orderkey, l_linenumber, count(*) occurrences from lineitem group by 1, 2 having count(*) > 1")
def qc12(spark, sf):
    return qc.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("qc12_vocabulary_gate", "", "select event_type, count(*) occurrences from events where event_type not in ('click', 'view') or event_type is null group by 1")
def qc12v(spark, sf):
    return qc.bad_values(load(spark, sf, "events"), "event_type", ["click", "view"])


READY = "select c_name genome_id, case when c_custkey % 6 = 0 then 2 else 0 end errors, c_custkey % 4 warnings, case when c_custkey % 5 = 0 then 'host' else '' end missing_fields, c_custkey % 7 = 0 review_required, case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then 'FAILED' else 'PASSED' end external_state from {c}"


@query("qc13_readiness", "", f"""
with r as ({READY.format(c='customer')}) select genome_id, missing_fields, case when errors > 0 or coalesce(external_state = 'FAILED', false) then 'VALIDATION_FAILED' when missing_fields <> '' then 'INCOMPLETE_METADATA' when review_required then 'REQUIRES_REVIEW' when external_state is null then 'PENDING_EXTERNAL_VALIDATION' when warnings > 0 then 'READY_WITH_WARNINGS' else 'READY' end readiness from r""")
def qc13(spark, sf):
    return qc.readiness(spark.sql(READY, c=load(spark, sf, "customer")))


@query("qc14_review_candidates", "sparse_models", """
with a as (select genome_id, model_id candidate_id, s, e, 'SHORT_ORF_WITH_HOMOLOGY' reason from sparse_models where provider = 'prodigal_gv' and e - s < 100 and s % 3 = 0), x as (select genome_id, model_id, s, e, lead(struct_pack(m := model_id, s := s, e := e)) over (partition by genome_id order by s, e, model_id) nx from sparse_models)
select * from a union all select genome_id, model_id || '|' || nx.m, least(s, nx.s), greatest(e, nx.e), 'POSSIBLE_SLIPPAGE' from x where nx is not null and nx.s - e between 1 and 40 union all select genome_id, model_id, s, e, 'STRICT_PRECISION_EXCLUSION' from sparse_models where provider = 'phanotate' and e % 71 = 0""")
def qc14(spark, sf):
    from virocohort.operators.ordering import ordinal, with_neighbours
    m = load(spark, sf, "sparse_models")
    short = m.where("provider = 'prodigal_gv' and e - s < 100").select("genome_id", F.col("model_id").alias("cand_id"), "s", "e", F.lit(False).alias("accepted"), F.expr("s % 3 = 0").alias("has_homology"))
    o = with_neighbours(ordinal(m, ["genome_id"], "s", ["s", "e", "model_id"]), ["genome_id"], "idx", 1, lambda f: {"nx": F.lead(F.struct("model_id", "s")).over(f.ordered)})
    pairs = o.where("nx.s - e between 1 and 40").select("genome_id", F.col("model_id").alias("first_cds"), F.col("nx.model_id").alias("second_cds"))
    cut = m.where("provider = 'phanotate'").select("genome_id", "model_id", "s", "e", F.expr("e % 71 = 0").alias("excluded"))
    return qc.review_candidates(short, pairs, cut, m)


@query("qc15_genome_summary", "calls contigs", f"""
with c as ({CDS_SQL}), k as (select genome_id, substr(cds, 1, 3) sc, count(*) n from c group by 1, 2), h as (select genome_id, sum(n)::bigint cds_count, string_agg(sc || ':' || n, ';' order by sc || ':' || n) start_codons from k group by 1),
 t as (select genome_id, count(*) filter (where e - s > 150) tier_high, count(*) filter (where e - s between 100 and 150) tier_medium, count(*) filter (where e - s < 100) tier_low, count(*) filter (where s % 50 = 0) rna_count from calls group by 1)
select genome_id, length(seq) length_nt, round(100 * (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq), 6) gc_percent, cds_count, start_codons, tier_high, tier_medium, tier_low, rna_count from contigs join h using (genome_id) join t using (genome_id)""")
def qc15(spark, sf):
    c = calls_with_cds(spark, sf).select("genome_id", F.substring("cds", 1, 3).alias("start_codon"), F.expr("case when e - s > 150 then 'high' when e - s >= 100 then 'medium' else 'low' end").alias("tier"))
    return rounded(qc.genome_summary(load(spark, sf, "contigs"), c, load(spark, sf, "calls").where("s % 50 = 0")))


ANNOT = "select protein_id, sha256_(concat(protein_id, functional_state)) source_sha256, coalesce(proposed_function, 'hypothetical protein') product, proposed_function, cast(null as varchar(9)) gene, '' note from {c}"
EDITS = """select case when s % 97 = 0 then concat('X', protein_id) else protein_id end protein_id, case when s % 89 = 0 then 'stale' else sha256_(concat(protein_id, functional_state)) end source_sha256, case when s % 2 = 0 then 'portal protein' else 'hypothetical protein' end product,
  'gp20' gene, cast(null as varchar(9)) note, case when s % 3 = 0 then '' else 'PMID:1' end evidence_reference, 'r1' reviewer from {c} where e % 6 = 0"""
dk = lambda t: t.replace("sha256_(", "sha256(")
sp = lambda t: t.replace("sha256_(concat(protein_id, functional_state))", "sha2(concat(protein_id, functional_state), 256)")
EDIT = f"""an as ({dk(ANNOT).format(c='classified')}), ed as ({dk(EDITS).format(c='classified')}), ej as (select ed.*, case when an.protein_id is null then 'UNKNOWN_PROTEIN' when an.source_sha256 <> ed.source_sha256 then 'SOURCE_CHECKSUM_MISMATCH' when ed.product <> 'hypothetical protein' and evidence_reference = '' then 'NAMED_PRODUCT_WITHOUT_EVIDENCE' end refused from ed left join an using (protein_id))"""


def edits(spark, sf):
    c = load(spark, sf, "classified")
    return cu.apply_edits(spark.sql(sp(ANNOT), c=c), spark.sql(sp(EDITS), c=c))


@query("cu01_apply_edits", "classified", f"""with {EDIT} select an.protein_id, coalesce(j.product, an.product) product, coalesce(j.product, an.proposed_function) proposed_function, coalesce(j.gene, an.gene) gene, coalesce(j.note, an.note) note, case when j.reviewer is not null then 'MANUALLY_REVIEWED' else 'AUTOMATIC' end curation_state, j.reviewer
 from an left join (select * from ej where refused is null) j on j.protein_id = an.protein_id""")
def cu01(spark, sf):
    return edits(spark, sf)[0]


@query("cu01_refused_edits", "classified", f"with {EDIT} select protein_id, refused from ej where refused is not null")
def cu01r(spark, sf):
    return edits(spark, sf)[1]


def chained(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("field"), F.col("value").cast("string").alias("after"))
    return cu.audit_chain(e, "user_id", ["event_id"])


@query("cu02_audit_chain")
def cu02(spark, sf):
    return chained(spark, sf)


@query("cu03_chain_verification", "", """
with e as (select *, lag(event_id) over (partition by user_id order by event_id) prev from events), cut as (select * from e where event_id % 997 <> 5)
select user_id, event_id, case when prev is not null and prev % 997 = 5 then 'CHAIN_BROKEN' else 'CHECKSUM_MISMATCH' end problem from cut where (prev is not null and prev % 997 = 5) or event_id % 500 = 7""")
def cu03(spark, sf):
    """A chain in which some events were removed and others altered after signing."""
    audit = chained(spark, sf).where("event_id % 997 <> 5").withColumn("payload", F.expr("if(event_id % 500 = 7, concat(payload, ' '), payload)"))
    return cu.verify_chain(audit, "user_id", "event_id", ["event_id"], 2000).select("user_id", "event_id", "problem")


CORR = "select protein_id, case when s % 2 = 0 then 'portal protein' end proposed_function, case when s % 3 = 0 then 'HIGH' end confidence from {c} where e % 5 = 0"


@query("cu04_revision_audit", "classified", f"""
with c as ({CORR.format(c='classified')}) select protein_id, 'proposed_function' field, a.proposed_function original, c.proposed_function corrected from classified a join c using (protein_id) where c.proposed_function is not null and a.proposed_function is distinct from c.proposed_function
union all select protein_id, 'confidence', a.confidence, c.confidence from classified a join c using (protein_id) where c.confidence is not null and a.confidence is distinct from c.confidence""")
def cu04(spark, sf):
    c = load(spark, sf, "classified")
    return cu.revise_submission(c, spark.sql(CORR, c=c), ["proposed_function", "confidence"])[1]


REVIEWS = "select case when l_partkey % 101 = 0 then 'NOPE' else concat('P', cast(l_orderkey as varchar(20))) end case_id, case l_returnflag when 'A' then 'correct' when 'N' then 'correct' else case when l_linenumber = 7 then 'maybe' else 'incorrect' end end verdict from {l} where l_quantity > 30"


@query("cu05_attach_reviews", "proteins", f"""
with r as ({REVIEWS.format(l='lineitem')}), g as (select case_id, count(*) n, min(verdict) lo, max(verdict) hi from r where verdict <> 'maybe' group by 1)
select protein_id case_id, coalesce(g.n, 0) review_count, case when lo = hi then lo end adjudication, case when lo is null then 'NOT_REVIEWED' when lo = hi then 'AGREED' else 'DISAGREEMENT' end review_state from proteins left join g on case_id = protein_id""")
def cu05(spark, sf):
    cases = load(spark, sf, "proteins").select(F.col("protein_id").alias("case_id"))
    return cu.attach_reviews(cases, spark.sql(REVIEWS, l=load(spark, sf, "lineitem")), ["correct", "incorrect"])[0]


@query("cu05_stray_reviews", "", f"with r as ({REVIEWS.format(l='lineitem')}) select case_id, case when verdict = 'maybe' then 'UNKNOWN_VERDICT' else 'UNKNOWN_CASE' end problem from r where verdict = 'maybe' or case_id = 'NOPE'")
def cu05s(spark, sf):
    cases = load(spark, sf, "proteins").select(F.col("protein_id").alias("case_id"))
    return cu.attach_reviews(cases, spark.sql(REVIEWS, l=load(spark, sf, "lineitem")), ["correct", "incorrect"])[1]


@query("tx12_blinding", "hits", """
select 'BLIND_' || substr(sha256('pepper' || hit_id), 1, 20) blinded_case_id, regexp_replace(description || ' by ' || source, '(?i)\\b(phanotate|prodigal(?:[-_]gv)?|pharokka|prokka|hmmscan|mmseqs2?|diamond|phrogs?|vogdb|pfam|swiss-?prot)\\b', '[REDACTED]', 'g') text from hits""")
def tx12(spark, sf):
    h = load(spark, sf, "hits").select("hit_id", "source", F.concat_ws(" by ", "description", "source").alias("text"))
    return cu.blind(h, F.col("hit_id"), "pepper", ["text"], ["source", "hit_id"])


LOCI2 = "select genome_id, s, e, strand, 'one' tool_1, 'two' tool_2, coalesce(proposed_function, 'none') product_1, functional_state product_2 from {c}"


@query("cu06_review_cases", "classified", f"""
with p as ({LOCI2.format(c='classified')}), h as (select *, sha256('salt' || concat_ws('|', genome_id, s, e, strand)) x from p), k as (select *, substr(x, 1, 1) < '8' sw from h)
select 'CASE_' || substr(x, 1, 20) case_id, genome_id, s, e, strand, case when sw then product_2 else product_1 end product_a, case when sw then product_1 else product_2 end product_b, case when sw then 'two' else 'one' end key_a, case when sw then 'one' else 'two' end key_b from k""")
def cu06(spark, sf):
    return cu.review_cases(spark.sql(LOCI2, c=load(spark, sf, "classified")), "salt")


ROWS = f"select protein_id case_id, coalesce(proposed_function, '') product, case when s % 3 = 0 then '{PENDING}' else 'EXACT_PRODUCT_AGREEMENT' end category from {{c}}"
DONE = "select protein_id case_id, case when e % 8 = 0 then 'other' else coalesce(proposed_function, '') end product, 'EQUIVALENT_FUNCTION' verdict from {c} where e % 4 = 0"


@query("cu07_apply_reviews", "classified", f"""
with r as ({ROWS.format(c='classified')}), d as ({DONE.format(c='classified')}), j as (select r.*, case when verdict is null then 'UNCHANGED' when r.product <> d.product then 'REFUSED_IMMUTABLE_FIELD' when category = '{PENDING}' then 'APPLIED' else 'IGNORED_NOT_PENDING' end outcome, verdict from r left join d using (case_id))
select case_id, product, category, outcome, case when outcome = 'APPLIED' then verdict else category end final_category from j""")
def cu07(spark, sf):
    c = load(spark, sf, "classified")
    return cu.apply_reviews(spark.sql(ROWS, c=c), spark.sql(DONE, c=c))


DECS = "select member_id case_id, sha sequence_sha256, md5(concat(sha, host_genus)) record_sha256 from {m} where n_chars % 3 > 0"
REVS = "select member_id case_id, case when n_chars % 13 = 0 then 'x' else sha end sequence_sha256, case when n_chars % 11 = 0 then 'y' else md5(concat(sha, host_genus)) end record_sha256, case when n_chars % 7 = 0 then 'odd' else 'SUPPORTED' end verdict from {m} where n_chars % 5 > 0 union all select member_id, sha, md5(concat(sha, host_genus)), 'SUPPORTED' from {m} where n_chars % 17 = 0"


@query("cu08_evidence_review", "members", f"""
with d as ({DECS.format(m='members')}), r as ({REVS.format(m='members')}), g as (select case_id, count(*) n, min(sequence_sha256) rs, min(record_sha256) rr, min(verdict) v from r group by 1),
 j as (select coalesce(d.case_id, g.case_id) case_id, v, case when d.case_id is null then 'UNKNOWN_CASE' when n is null then 'NOT_REVIEWED' when n > 1 then 'REVIEWED_TWICE' when rs <> sequence_sha256 then 'SEQUENCE_CHANGED' when rr <> record_sha256 then 'RECORD_CHANGED' when v <> 'SUPPORTED' then 'UNKNOWN_VERDICT' else 'OK' end state from d full join g using (case_id))
select case_id, state, case when state = 'OK' then v end verdict from j""")
def cu08(spark, sf):
    m = load(spark, sf, "members")
    return cu.evidence_review(spark.sql(DECS, m=m), spark.sql(REVS, m=m), ["SUPPORTED"])


@query("cu09_reclassify", "hits", f"with {FULL} select functional_state, confidence, evidence_tier, count(*) proteins from fin group by all")
def cu09(spark, sf):
    """Classification rerun from stored evidence, without any search, summarised by outcome."""
    return fu.classify(classified_hits(spark, sf)).groupBy("functional_state", "confidence", "evidence_tier").agg(F.count("*").alias("proteins"))


BASE = "select genome_id, protein_id, 'hypothetical protein' annotation from {c} where s % 5 > 0"
CLS = "select genome_id, protein_id, proposed_function product, functional_state from {c} where s % 7 > 0"
CUR = "select genome_id, protein_id, 'portal protein' product from {c} where s % 11 = 0"
EXT = "select genome_id, protein_id, case when e % 2 = 0 then 'Major capsid protein' else 'holin' end proposed_product from {c} where e % 3 = 0"


@query("cu10_unified_records", "classified", f"""
with b as ({BASE.format(c='classified')}), c as ({CLS.format(c='classified')}), u as ({CUR.format(c='classified')}), x as (select genome_id, protein_id, count(*) n, min(proposed_product) fp from ({EXT.format(c='classified')}) group by 1, 2),
 j as (select genome_id, protein_id, coalesce(u.product, c.product, annotation) product, coalesce(functional_state, 'UNRESOLVED') functional_state, case when u.product is not null then 'CURATED' when c.product is not null then 'CLASSIFIED' else 'BASE' end product_origin, coalesce(n, 0) external_proposals, fp from b full join c using (genome_id, protein_id) left join u using (genome_id, protein_id) left join x using (genome_id, protein_id))
select genome_id || '|' || protein_id record_id, genome_id, protein_id, product, functional_state, product_origin, external_proposals, coalesce(fp is not null and product is not null and product <> 'hypothetical protein' and lower(fp) <> lower(product), false) external_conflict from j""")
def cu10(spark, sf):
    c = load(spark, sf, "classified")
    return cu.unified_records(*[spark.sql(t, c=c) for t in (BASE, CLS, CUR, EXT)])


GCALL = "select genome_id, protein_id, case when s % 5 = 0 then 'POSSIBLE_FALSE_CALL' when s % 5 = 1 then 'REVIEW_BOUNDARIES' else 'NONE' end review_flag from {c}"
HMARK = "select genome_id, case when e % 2 = 0 then 'portal' else 'lysis' end hallmark, case when min(s) % 2 = 0 then 'DETECTED' else 'NOT_ESTABLISHED' end status from {c} group by genome_id, e % 2"


@query("gm08_review_queue", "classified", f"""
with g as ({GCALL.format(c='classified')}), h as ({HMARK.format(c='classified')})
select genome_id, protein_id subject, 'FUNCTION_ASSIGNMENT' review_type, case when functional_state = 'CONFLICTING_EVIDENCE' then 'HIGH' else 'MEDIUM' end priority from classified where functional_state in ('UNRESOLVED', 'CONFLICTING_EVIDENCE') or s % 10 = 0
union all select genome_id, protein_id, 'GENE_CALL', case when review_flag = 'POSSIBLE_FALSE_CALL' then 'HIGH' else 'MEDIUM' end from g where review_flag <> 'NONE' union all select genome_id, hallmark, 'HALLMARK_NOT_ESTABLISHED', case when hallmark = 'portal' then 'HIGH' else 'LOW' end from h where status <> 'DETECTED'""")
def gm08(spark, sf):
    c = load(spark, sf, "classified")
    return cu.review_queue(c.withColumn("ambiguity_flags", F.expr("if(s % 10 = 0, 'x', '')")), spark.sql(GCALL, c=c), spark.sql(HMARK, c=c))


@query("gm09_triage", "sparse_models hits", f"""
with {SELECTION}, loc as (select component, genome_id from loci), d as (select genome_id, count(*) filter (where decision_class in ('STRAND_CONFLICT_UNRESOLVED', 'SPLIT_MERGE_UNRESOLVED', 'BOUNDARY_CONFLICT_UNRESOLVED', 'INSUFFICIENT_COMPARATIVE_EVIDENCE')) unresolved_conflicts from decs group by 1),
 s as (select genome_id, count(selected_candidate) final_genes, count(*) filter (where changed_from_legacy) boundary_changes, count(*) filter (where selection_rule like 'RESCUE%') rescue_candidates, count(*) filter (where review_priority = 'HIGH_PRIORITY_REVIEW') high_priority from sel join loc using (component) group by 1),
 u as (select genome_id, count(*) unresolved_functions from sparse_models where e % 7 = 0 group by 1)
select genome_id, final_genes, boundary_changes, rescue_candidates, high_priority, unresolved_conflicts, coalesce(unresolved_functions, 0) unresolved_functions from s join d using (genome_id) left join u using (genome_id)""")
def gm09(spark, sf):
    members, decisions = decided(spark, sf)
    decisions = cut_lineage(decisions)  # counted, and read again by the selection
    c = members.where("e % 7 = 0").select("genome_id", F.lit("UNRESOLVED").alias("functional_state"), F.lit("NONE").alias("review_flag"))
    return cu.triage(decisions, rc.select_models(decisions, members), c)


XLAB = "select concat('P', cast(o_orderkey as varchar(20))) protein_id, case when o_orderkey % 2 = 0 then 'Endolysin' else 'integrase' end proposed_product from {o}"


@query("gm10_conflict_table", "hits", f"""
with {FULL}, x as ({XLAB.format(o='orders')}) select protein_id, 'ENGINE_EVIDENCE_CONFLICT' kind, display_product current_product, null proposed_product from fin where conflict
union all select protein_id, 'EXTERNAL_LABEL_DIFFERENCE', display_product, proposed_product from x join fin using (protein_id) where {inf_sql('display_product')} and {prod_sql('display_product')} <> lower(proposed_product)""")
def gm10(spark, sf):
    return cu.conflict_table(fu.classify(classified_hits(spark, sf)), spark.sql(XLAB, o=load(spark, sf, "orders")))
