"""Interval, locus and gene-model queries (IV01-IV23, GM01-GM07)."""

from pyspark.sql import functions as F

from virocohort.operators import intervals as iv
from virocohort.operators import reconcile as rc
from virocohort.operators import screens as sc
from virocohort.plans.registry import query
from virocohort.plans.tables import load
from virocohort.session import cut_lineage

PAIRS = """p as (select a.genome_id, a.model_id id_a, b.model_id id_b, least(a.e, b.e) - greatest(a.s, b.s) + 1 ov, a.e - a.s + 1 la, b.e - b.s + 1 lb,
  a.s sa, a.e ea, a.strand da, b.s sb, b.e eb, b.strand db
  from {0} a join {0} b on a.genome_id = b.genome_id and a.model_id < b.model_id and a.s <= b.e and a.e >= b.s)"""


def callers(spark, sf, table="sparse_models"):
    m = load(spark, sf, table)
    return m.where("provider = 'phanotate'"), m.where("provider = 'prodigal_gv'")


@query("iv01_overlap_join", "gene_models", f"with {PAIRS.format('gene_models')} select genome_id, id_a, id_b, ov overlap from p")
def iv01(spark, sf):
    m = load(spark, sf, "gene_models").select("genome_id", "model_id", "s", "e")
    return iv.self_overlap(m, ["genome_id"], "model_id").select(
        "genome_id", F.col("model_id_a").alias("id_a"), F.col("model_id_b").alias("id_b"), F.col("overlap").cast("bigint").alias("overlap"))


@query("iv02_meaningful_overlap", "gene_models", f"""with {PAIRS.format('gene_models')} select id_a, id_b, round(least(ov / la, ov / lb), 6) reciprocal from p
  where (ov >= 30 and least(ov / la, ov / lb) >= 0.1) or least(ov / la, ov / lb) >= 0.5""")
def iv02(spark, sf):
    m = load(spark, sf, "gene_models").select("genome_id", "model_id", "s", "e")
    la, lb = iv.length(F.col("s_a"), F.col("e_a")), iv.length(F.col("s_b"), F.col("e_b"))
    return iv.self_overlap(m, ["genome_id"], "model_id").where(iv.meaningful(F.col("overlap"), la, lb)).select(
        F.col("model_id_a").alias("id_a"), F.col("model_id_b").alias("id_b"), F.round(iv.reciprocal(F.col("overlap"), la, lb), 6).alias("reciprocal"))


@query("iv03_max_same_strand_overlap", "gene_models", """
select a.model_id, coalesce(max(least(a.e, b.e) - greatest(a.s, b.s) + 1) filter (where b.s is not null), 0)::bigint max_overlap from gene_models a
left join gene_models b on a.genome_id = b.genome_id and a.strand = b.strand and a.model_id <> b.model_id and a.s <= b.e and a.e >= b.s group by 1""")
def iv03(spark, sf):
    m = load(spark, sf, "gene_models").select("genome_id", "strand", "model_id", "s", "e")
    return iv.max_overlap(m, ["genome_id", "strand"], "model_id").select("model_id", "max_overlap")


EDGES = f"""{PAIRS.format('sparse_models')}, e0 as (select id_a u, id_b v from p where (ov >= 30 and least(ov / la, ov / lb) >= 0.1) or least(ov / la, ov / lb) >= 0.5),
 sym as (select u, v from e0 union all select v, u from e0),
 reach as (select model_id u, model_id v from sparse_models union select r.u, s.v from reach r join sym s on r.v = s.u),
 members as (select m.*, c.component from sparse_models m join (select u model_id, min(v) component from reach group by 1) c using (model_id))"""
LOCI = f"""{EDGES}, pp as (select genome_id, component, provider, count(*) n, min(s) s0, max(s) s1, min(e) e0, max(e) e1, min(strand) d0, max(strand) d1 from members group by all),
 lo as (select genome_id, component, sum(n)::bigint candidate_count, count(*) provider_count, max(n) most, min(n) least_n, arg_min(n, provider) first_n, min(s0) st, max(s1) ls, min(e0) fe, max(e1) en,
   min(d0) d0, max(d1) d1, string_agg(provider, ';' order by provider) supporting_providers from pp group by all),
 loci as (select genome_id, component, 'LOCUS_' || substr(sha256(concat_ws('|', genome_id, st, en, candidate_count, component)), 1, 16) locus_id, st "start", en "end",
   case when d0 = d1 then 'CONCORDANT' else 'DISCORDANT' end strand_status, candidate_count, provider_count, supporting_providers,
   case when d0 <> d1 then 'STRAND_DISCORDANCE' when most > 1 and provider_count = 2 and least_n = 1 then case when first_n = 1 then 'SPLIT_MODEL' else 'MERGED_MODEL' end
     when most > 1 and provider_count > 1 then 'COMPLEX_CONFLICT' when st = ls and fe = en then case when provider_count > 1 then 'EXACT_CONCORDANCE' else 'CALLER_SPECIFIC' end
     when fe = en then 'COMMON_STOP_ALTERNATE_START' when st = ls then 'COMMON_START_ALTERNATE_STOP'
     when provider_count > 1 then 'BOUNDARY_DISCORDANCE' else 'CALLER_SPECIFIC' end reconciliation_class,
   not (st = ls and fe = en) or d0 <> d1 or (most > 1 and provider_count > 1) review_required from lo)"""


@query("iv04_locus_members", "sparse_models", f"with {EDGES} select genome_id, model_id, component from members")
def iv04(spark, sf):
    return rc.locus_members(load(spark, sf, "sparse_models")).select("genome_id", "model_id", "component")


def locus_tables(spark, sf):
    members = rc.locus_members(load(spark, sf, "sparse_models"))
    return members, rc.loci(members)


@query("iv05_locus_class", "sparse_models", f"with {LOCI} select * from loci")
def iv05(spark, sf):
    return locus_tables(spark, sf)[1]


@query("iv06_coordinate_groups", "sparse_models", f"""with {EDGES}, k as (
  select genome_id, component, model_id, provider, 'exact' group_kind, s || '|' || e || '|' || strand group_key from members
  union all select genome_id, component, model_id, provider, 'start', s::varchar from members union all select genome_id, component, model_id, provider, 'stop', e::varchar from members
  union all select genome_id, component, model_id, provider, 'strand', strand from members)
select genome_id, component, group_kind, group_key, count(*) candidates, min(model_id) first_candidate, string_agg(distinct provider, ';' order by provider) supporting_providers from k group by all""")
def iv06(spark, sf):
    return rc.coordinate_groups(rc.locus_members(load(spark, sf, "sparse_models")))


PRODUCTION = """rel as (select *, case reconciliation_class when 'EXACT_CONCORDANCE' then 'EXACT_MATCH' when 'COMMON_STOP_ALTERNATE_START' then 'SAME_STOP_DIFFERENT_START'
   when 'COMMON_START_ALTERNATE_STOP' then 'NEAR_BOUNDARY_MATCH' when 'BOUNDARY_DISCORDANCE' then 'NEAR_BOUNDARY_MATCH' when 'SPLIT_MODEL' then 'OVERLAPPING_ALTERNATIVE'
   when 'MERGED_MODEL' then 'OVERLAPPING_ALTERNATIVE' when 'CALLER_SPECIFIC' then case when contains(supporting_providers, 'phanotate') then 'PHANOTATE_ONLY' else 'PYRODIGAL_GV_ONLY' end
   else 'CONFLICTING_ORF' end relationship from loci),
 prod as (select *, case relationship when 'EXACT_MATCH' then 'MODERATE' when 'PYRODIGAL_GV_ONLY' then 'UNRESOLVED' else 'LOW' end structural_confidence from rel)"""


@query("iv07_production_relationship", "sparse_models", f"""with {LOCI}, {PRODUCTION} select component, relationship, structural_confidence,
 case when structural_confidence in ('LOW', 'UNRESOLVED') then 'REVIEW_REQUIRED' else 'NONE' end review_flag from prod""")
def iv07(spark, sf):
    return rc.production_relationship(locus_tables(spark, sf)[1]).select("component", "relationship", "structural_confidence", "review_flag")


# one search result per candidate, taken from the alignment of the same row
CANDIDATE_EVIDENCE = """select hit_id model_id, source, identifier, description, evalue <= 1e-10 supports,
  case when evalue <= 1e-30 then 'STRONG' when evalue <= 1e-10 then 'MODERATE' else 'REJECTED' end strength, evalue from {hits}"""


def candidate_evidence(spark, sf):
    return spark.sql(CANDIDATE_EVIDENCE, hits=load(spark, sf, "hits"))


EV = f"ev as ({CANDIDATE_EVIDENCE.format(hits='hits')})"


@query("iv08_final_structural_confidence", "sparse_models hits", f"""with {LOCI}, {PRODUCTION}, {EV},
 agg as (select component, count(*) n, bool_or(supports) sup, bool_or(supports and strength = 'STRONG') strong, bool_or(not supports) conf, string_agg(distinct source, ';' order by source) src
   from members join ev using (model_id) group by 1)
select component, case when strong and relationship = 'EXACT_MATCH' then 'HIGH' when sup and not conf and relationship in ('EXACT_MATCH', 'PHANOTATE_ONLY') then 'MODERATE'
  when conf and not sup then 'LOW' else structural_confidence end structural_confidence, n evidence_count, src evidence_sources, conf evidence_conflict from prod join agg using (component)""")
def iv08(spark, sf):
    members, table = locus_tables(spark, sf)
    ev = candidate_evidence(spark, sf).join(members.select("model_id", "component"), "model_id")
    return rc.finalise_confidence(rc.production_relationship(table), ev).select(
        "component", "structural_confidence", "evidence_count", "evidence_sources", "evidence_conflict")


SIDES = """ph as (select * from sparse_models where provider = 'phanotate'), pr as (select * from sparse_models where provider = 'prodigal_gv'),
 big as (select a.genome_id, a.model_id p, b.model_id d, a.s s1, a.e e1, a.strand d1, b.s s2, b.e e2, b.strand d2, least(a.e, b.e) - greatest(a.s, b.s) + 1 ov
   from ph a join pr b on a.genome_id = b.genome_id and a.s <= b.e and a.e >= b.s and (least(a.e, b.e) - greatest(a.s, b.s) + 1) / greatest(a.e - a.s + 1, b.e - b.s + 1) >= 0.5),
 n as (select *, count(*) over (partition by genome_id, p) n from big),
 rec as (select ph.genome_id, ph.model_id phanotate_id, case when n = 1 then n.d end prodigal_id, case when n = 1 then ov else 0 end overlap_bp,
   case when n is null then 'PHANOTATE_ONLY' when n > 1 then 'SPLIT_MODEL' when d1 <> d2 then 'STRAND_DISCORDANCE' when s1 = s2 and e1 = e2 then 'EXACT_CONCORDANCE'
     when e1 = e2 then 'START_DISCORDANCE' when s1 = s2 then 'STOP_DISCORDANCE' else 'START_AND_STOP_DISCORDANCE' end conflict_type
   from ph left join n on ph.genome_id = n.genome_id and ph.model_id = n.p qualify row_number() over (partition by ph.genome_id, ph.model_id order by n.d) = 1
   union all select genome_id, null, model_id, 0, 'PRODIGAL_ONLY' from pr anti join big on pr.genome_id = big.genome_id and pr.model_id = big.d)"""


@query("iv09_pairwise_reconciliation", "sparse_models", f"with {SIDES} select * from rec")
def iv09(spark, sf):
    return rc.reconcile_pair(*callers(spark, sf))


@query("iv10_greedy_pairing")
def iv10(spark, sf):
    return rc.greedy_pairs(*callers(spark, sf))


@query("iv11_candidate_relationship", "gene_models", f"""with {PAIRS.format('gene_models')} select id_a, id_b,
 case when sa = sb and ea = eb and da = db then 'EXACT_MATCH' when ea = eb and sa <> sb then 'SAME_STOP_DIFFERENT_START' when da = db and ov / least(la, lb) >= 0.8 then 'NEAR_BOUNDARY_MATCH'
  when da = db then 'OVERLAPPING_ALTERNATIVE' else 'CONFLICTING_ORF' end relationship from p""")
def iv11(spark, sf):
    m = load(spark, sf, "gene_models").select("genome_id", "model_id", "s", "e", "strand")
    rel = rc.candidate_relationship(*[F.col(c) for c in ("s_a", "e_a", "strand_a", "s_b", "e_b", "strand_b")])
    return iv.self_overlap(m, ["genome_id"], "model_id").select(
        F.col("model_id_a").alias("id_a"), F.col("model_id_b").alias("id_b"), rel.alias("relationship"))


@query("iv12_coding_density", "sparse_models", """
with o as (select *, max(e) over (partition by genome_id order by s, e rows between unbounded preceding and 1 preceding) pe from sparse_models)
select genome_id, sum(greatest(0, e - greatest(coalesce(pe, s - 1), s - 1)))::bigint coding_bases,
  round(100.0 * sum(greatest(0, e - greatest(coalesce(pe, s - 1), s - 1))) / 400500, 6) coding_density_percent from o group by 1""")
def iv12(spark, sf):
    c = iv.covered_length(load(spark, sf, "sparse_models"), ["genome_id"])
    return c.select("genome_id", F.col("covered").alias("coding_bases"), F.round(100.0 * F.col("covered") / 400500, 6).alias("coding_density_percent"))


@query("iv13_overlap_types", "gene_models", f"""with {PAIRS.format('gene_models')},
 o as (select genome_id, case when f then id_a else id_b end left_id, case when f then id_b else id_a end right_id, case when f then ea else eb end le, case when f then sb else sa end rs,
   case when f then eb else ea end re, da = db same_strand from (select *, (sa, ea, da, id_a) <= (sb, eb, db, id_b) f from p))
select genome_id, left_id, right_id, case when rs = le then 'shared_boundary' when re <= le then 'nested_overlap' else 'partial_overlap' end overlap_type, le - rs + 1 overlap_bases, same_strand from o""")
def iv13(spark, sf):
    return iv.neighbour_overlaps(load(spark, sf, "gene_models"), ["genome_id"], "model_id")


@query("iv14_uncovered_length", "sparse_models", f"""
with {SIDES}, o as (select b.genome_id, b.model_id, greatest(a.s, b.s) cs, least(a.e, b.e) ce from ph a join pr b on a.genome_id = b.genome_id and a.s <= b.e and a.e >= b.s),
 w as (select *, max(ce) over (partition by model_id order by cs, ce rows between unbounded preceding and 1 preceding) pe from o),
 c as (select model_id, sum(greatest(0, ce - greatest(coalesce(pe, cs - 1), cs - 1))) covered from w group by 1)
select genome_id, model_id, (e - s + 1 - coalesce(covered, 0))::bigint uncovered from pr left join c using (model_id)""")
def iv14(spark, sf):
    ph, pr = callers(spark, sf)
    return iv.uncovered_length(pr.select("genome_id", "model_id", "s", "e"), ph.select("genome_id", F.col("s").alias("os"), F.col("e").alias("oe")),
                               ["genome_id"], "model_id", ("s", "e"), ("os", "oe")).select("genome_id", "model_id", "uncovered")


# the second caller's models stand for regulatory features, of either strand
FEATURES = "select genome_id, model_id feature_id, s, s + 19 e from {models} where provider = 'prodigal_gv'"


@query("iv15_feature_cds_overlap", "sparse_models", f"""
with f as ({FEATURES.format(models='sparse_models')}), c as (select * from sparse_models where provider = 'phanotate')
select f.genome_id, feature_id, count(c.model_id) = 0 accepted, case when count(c.model_id) > 0 then 'REGULATORY_FEATURE_OVERLAPS_CDS' end reason
from f left join c on f.genome_id = c.genome_id and f.s <= c.e and f.e >= c.s group by 1, 2""")
def iv15(spark, sf):
    m = load(spark, sf, "sparse_models")
    features = spark.sql(FEATURES, models=m)
    return sc.split_regulatory(features, m.where("provider = 'phanotate'")).select("genome_id", "feature_id", "accepted", "reason")


@query("iv16_best_hsp_per_base", "hsps", """
with x as (select *, unnest(range(qs, qe + 1)) pos from hsps),
 b as (select * from x qualify row_number() over (partition by pair_id, pos order by score desc, qs desc, qe desc, aln_len desc, nident desc) = 1)
select pair_id, round(sum(nident / aln_len), 6) identical, count(*) aligned_bases from b group by 1""")
def iv16(spark, sf):
    return iv.best_hsp_per_base(load(spark, sf, "hsps"), ["pair_id"]).select("pair_id", F.round("identical", 6).alias("identical"), "aligned_bases")


def reference_alignments(spark, sf):
    """Contigs aligned to references derived from them: two identical stretches around a deletion,
    every other genome read on the other strand."""
    c = load(spark, sf, "contigs").withColumn("n", F.expr("cast(substr(genome_id, 2) as int)"))
    part = lambda qs, width, shift, gap: c.select(
        F.concat("genome_id", F.lit(f"_{qs}")).alias("hsp_id"), "genome_id", F.col("genome_id").alias("reference_id"),
        F.lit(qs).alias("qs"), F.lit(qs + width - 1).alias("qe"), F.lit(qs - shift).alias("ss"), F.lit(qs - shift + width - 1 - gap).alias("se"),
        F.expr(f"substr(seq, {qs}, {width})").alias("qseq"),
        F.expr(f"concat(substr(seq, {qs}, 300), repeat('-', {gap}), substr(seq, {qs} + 300 + {gap}, {width} - 300 - {gap}))").alias("sseq"))
    return part(1, 900, 0, 0).unionByName(part(1001, 1000, 50, 6))


IV17_GENES = "select genome_id reference_id, model_id gene, s rs, e re, case when strand = '+' then 1 else -1 end rstrand from {calls} where provider = 'prodigal_gv'"


@query("iv17_reference_projection", "calls contigs", f"""
with g as ({IV17_GENES.format(calls='calls')}), c as (select genome_id, model_id, s, e, strand from calls where provider = 'phanotate'),
 m as (select *, case when rs >= 1 and re <= 900 then rs when rs >= 951 and re <= 1250 then rs + 50 when rs >= 1251 and re <= 1944 then rs + 56
        when rs between 951 and 1250 and re between 1251 and 1944 then rs + 50 end qs,
   case when rs >= 1 and re <= 900 then re when rs >= 951 and re <= 1250 then re + 50 when rs >= 1251 and re <= 1944 then re + 56
        when rs between 951 and 1250 and re between 1251 and 1944 then re + 56 end qe from g),
 h as (select m.reference_id, gene, count(*) hits, bool_or(c.s = qs and c.e = qe) exact from m join c on m.reference_id = c.genome_id and c.strand = case when rstrand = 1 then '+' else '-' end and c.s <= qe and c.e >= qs group by 1, 2)
select reference_id genome_id, reference_id, gene, qs query_start, qe query_end, case when qs is null then 'UNMAPPABLE_REFERENCE_CDS' when qe - qs <> re - rs then 'INDEL_REQUIRES_REVIEW' when exact then 'EXACT_BOUNDARY_SUPPORT'
  when hits > 0 then 'BOUNDARY_DISAGREEMENT' else 'POSSIBLE_MISSED_CDS' end status from m left join h using (reference_id, gene)""")
def iv17(spark, sf):
    calls = load(spark, sf, "calls")
    own = calls.where("provider = 'phanotate'")
    return sc.project_reference_cds(sc.aligned_blocks(reference_alignments(spark, sf)), spark.sql(IV17_GENES, calls=calls), own).select(
        "genome_id", "reference_id", "gene", F.col("query_start").cast("bigint").alias("query_start"), F.col("query_end").cast("bigint").alias("query_end"), "status")


SPLIT_HITS = """select model_id, 'Swiss-Prot' source, concat('T', cast(s % 7 as varchar(10))) target, s % 500 subject_start, s % 500 + (e - s) / 3 subject_end, 1e-10 evalue from {models}"""


FRAMESHIFTS = f"""
with h as ({SPLIT_HITS.format(models='gene_models')}), o as (select *, lead(struct_pack(m := model_id, s := s, e := e)) over (partition by genome_id, strand order by s, e, model_id) nx from gene_models),
 p as (select genome_id, strand, case when strand = '+' then model_id else nx.m end a, case when strand = '+' then nx.m else model_id end b, nx.s - e - 1 gap_nt,
   case when strand = '+' then (s - 1) % 3 else nx.e % 3 end fa, case when strand = '+' then (nx.s - 1) % 3 else e % 3 end fb from o where nx is not null)
select p.genome_id, a first_cds, b second_cds, x.source, x.target, gap_nt from p join h x on x.model_id = a join h y on y.model_id = b and x.source = y.source and x.target = y.target
where gap_nt between -30 and 100 and fa <> fb and x.subject_start < y.subject_start and x.subject_end <= y.subject_start + 10"""


@query("iv18_frameshift_candidates", "gene_models", FRAMESHIFTS)
def iv18(spark, sf):
    m = load(spark, sf, "gene_models")
    return sc.frameshift_candidates(m, spark.sql(SPLIT_HITS, models=m))


@query("iv19_slippage_review", "gene_models", f"""
with al as ({FRAMESHIFTS}), m as (select genome_id, unnest([first_cds, second_cds]) model_id from al), n as (select genome_id, model_id, count(*) n from m group by 1, 2)
select g.genome_id, g.model_id, coalesce(n, 0) slippage_alerts, case when n > 0 then 'REVIEW_REQUIRED_NOT_ASSERTED' end status from gene_models g left join n using (genome_id, model_id)""")
def iv19(spark, sf):
    m = load(spark, sf, "gene_models")
    return sc.slippage_review(sc.frameshift_candidates(m, spark.sql(SPLIT_HITS, models=m)), m)


@query("iv20_nearest_call", "sparse_models", f"""
with {SIDES} select ph.genome_id, ph.model_id sentinel_id, arg_min(pr.model_id, (abs(pr.s - ph.s), pr.s, pr.model_id)) nearest_call, min(abs(pr.s - ph.s)) start_distance
from ph join pr using (genome_id) group by 1, 2""")
def iv20(spark, sf):
    ph, pr = callers(spark, sf)
    return sc.nearest_start(ph.withColumnRenamed("model_id", "sentinel_id"), pr, ["genome_id"], "sentinel_id")


SENTINELS = "select genome_id, model_id sentinel_id, s, e from {models} where strand = '-'"


@query("iv20_sentinel_stages", "sparse_models", f"""
with z as ({SENTINELS.format(models='sparse_models')}), c as (select * from sparse_models where strand = '+'), f as (select * from c where provider = 'phanotate'),
 r as (select z.genome_id, sentinel_id, string_agg(distinct c.provider, ';' order by c.provider) callers, count(*) n from z join c on z.genome_id = c.genome_id and z.s <= c.e and z.e >= c.s group by 1, 2),
 k as (select distinct z.genome_id, sentinel_id, true fin from z join f on z.genome_id = f.genome_id and z.s <= f.e and z.e >= f.s)
select z.genome_id, z.sentinel_id, case when fin then 'FINAL_SELECTED' when callers is not null then 'DROPPED_AT_SELECTION_OR_ADJUDICATION' else 'NEVER_CALLED_BY_AVAILABLE_CALLER' end stage,
 coalesce(callers, '') callers, coalesce(n, 0) overlapping_calls from z left join r using (genome_id, sentinel_id) left join k using (genome_id, sentinel_id)""")
def iv20_stage(spark, sf):
    m = load(spark, sf, "sparse_models")
    calls = m.where("strand = '+'")
    return sc.sentinel_stages(spark.sql(SENTINELS, models=m), calls, calls.where("provider = 'phanotate'").select("genome_id", "s", "e"))


SPANINS = """select genome_id, strand, model_id, s, e, case when (e - s) % 4 = 1 then 'Rz-like spanin' when provider = 'phanotate' then 'spanin' else 'Rz1-like spanin' end name, provider = 'prodigal_gv' outer_support from {models}"""


@query("iv21_spanin_pairs", "sparse_models", f"""
with g as ({SPANINS.format(models='sparse_models')}),
 p as (select u.genome_id, u.model_id inner_id, d.model_id outer_id, case when u.strand = '+' then d.s - u.e - 1 else u.s - d.e - 1 end gap_nt, case when u.strand = '+' then d.s - u.s else u.e - d.e end sh
   from g u join g d on u.genome_id = d.genome_id and u.strand = d.strand and u.model_id <> d.model_id and d.s <= u.e + 16 and d.e >= u.s - 16
   where u.name in ('Rz-like spanin', 'spanin') and d.outer_support),
 k as (select *, sh % 3 relative_frame from p where sh > 0 and ((gap_nt < 0 and sh % 3 = 1) or gap_nt between 0 and 15)),
 n as (select genome_id, m from (select genome_id, inner_id m from k union all select genome_id, outer_id from k) group by 1, 2 having count(*) = 1)
select k.* exclude (sh) from k semi join n a on k.genome_id = a.genome_id and k.inner_id = a.m semi join n b on k.genome_id = b.genome_id and k.outer_id = b.m""")
def iv21(spark, sf):
    return sc.spanin_pairs(spark.sql(SPANINS, models=load(spark, sf, "sparse_models")))


@query("iv22_short_cds_review", "sparse_models", f"""
with {SIDES} select ph.genome_id, ph.model_id, 'PRIMARY' source, case when x.s is not null then 'EXACT_SECONDARY_SUPPORT' else 'REVIEW_SHORT_PRIMARY_CDS' end assessment
 from ph left join (select distinct genome_id, s, e, strand from pr) x using (genome_id, s, e, strand) where ph.e - ph.s + 1 < 100
union all select pr.genome_id, pr.model_id, 'SECONDARY_ONLY', case when exists (select 1 from ph where ph.genome_id = pr.genome_id and ph.strand = pr.strand and ph.s <= pr.e and ph.e >= pr.s) then 'DISPUTED_BOUNDARY' else 'POSSIBLE_MISSED_SHORT_CDS' end
 from pr anti join ph using (genome_id, s, e, strand) where pr.e - pr.s + 1 < 100""")
def iv22(spark, sf):
    return sc.short_cds_review(*callers(spark, sf))


TABLES = "select genome_id, case when e % 97 = 0 then 15 when s % 89 = 0 then 4 else 11 end translation_table from {models} where provider = 'prodigal_gv'"


@query("iv23_alternative_codes", "sparse_models", f"""
with t as ({TABLES.format(models='sparse_models')}) select genome_id, string_agg(distinct translation_table::varchar, ',' order by lpad(translation_table::varchar, 3, ' ')) observed_tables,
 coalesce(string_agg(distinct translation_table::varchar, ',' order by lpad(translation_table::varchar, 3, ' ')) filter (where translation_table <> 11), '') alternative_tables,
 count(*) filter (where translation_table <> 11) alternative_calls, case when count(*) filter (where translation_table <> 11) > 0 then 'REVIEW_REQUIRED' else 'NO_ALTERNATIVE_IN_NATIVE_CALLS' end status
from t group by 1""")
def iv23(spark, sf):
    return sc.alternative_codes(spark.sql(TABLES, models=load(spark, sf, "sparse_models")))


STATUS = "case when evalue <= 1e-45 then 'CACHE_REUSED' when evalue >= 1e-1 then 'RESOURCE_UNAVAILABLE' else 'SEARCH_EXECUTED' end"
DECISIONS = f"""{LOCI}, {EV}, mem as (select m.*, {STATUS} evidence_status from members m join ev using (model_id)),
 str as (select distinct genome_id, component, m.model_id, provider, source, identifier, description from mem m join ev using (model_id) where supports and strength = 'STRONG'),
 shr as (select *, count(*) over (partition by genome_id, component, source, identifier, description) > 1 shared from str),
 pm as (select genome_id, component, model_id, provider, bool_or(shared) shares from shr group by all),
 win as (select genome_id, component, count(*) winners, count(*) filter (where not shares) uniq, min(struct_pack(m := model_id, p := provider)) filter (where not shares) u, min(struct_pack(p := provider, m := model_id)) anyw from pm group by all),
 st as (select genome_id, component, bool_and(evidence_status in ('SEARCH_EXECUTED', 'CACHE_REUSED', 'SEARCH_EXECUTED_ZERO_HITS')) all_s, bool_or(evidence_status = 'RESOURCE_UNAVAILABLE') miss,
   min(struct_pack(p := provider, m := model_id)) ld, count(distinct (s, e, strand)) = 1 exact from mem group by all),
 dd as (select l.*, exact, coalesce(winners, 0) w, coalesce(uniq, 0) q, u, anyw, ld, all_s, miss from loci l join st using (genome_id, component) left join win using (genome_id, component)),
 dec0 as (select *, case when exact and provider_count > 1 then 'EXACT_CONSENSUS' when exact then case when w > 0 then 'CALLER_SPECIFIC_WITH_STRONG_EVIDENCE' else 'CALLER_SPECIFIC_WITH_WEAK_EVIDENCE' end
   when strand_status = 'DISCORDANT' then 'STRAND_CONFLICT_UNRESOLVED' when reconciliation_class in ('SPLIT_MODEL', 'MERGED_MODEL', 'COMPLEX_CONFLICT') then 'SPLIT_MERGE_UNRESOLVED'
   when q = 1 then 'MODEL_SPECIFIC_EVIDENCE_FAVORS_CANDIDATE' when reconciliation_class = 'COMMON_STOP_ALTERNATE_START' then case when w > 1 then 'CONSENSUS_ALTERNATE_START' else 'BOUNDARY_CONFLICT_UNRESOLVED' end
   when reconciliation_class = 'COMMON_START_ALTERNATE_STOP' then case when w > 1 then 'CONSENSUS_ALTERNATE_STOP' else 'BOUNDARY_CONFLICT_UNRESOLVED' end else 'INSUFFICIENT_COMPARATIVE_EVIDENCE' end decision_class from dd),
 decs as (select *, case decision_class when 'EXACT_CONSENSUS' then ld.m when 'CALLER_SPECIFIC_WITH_STRONG_EVIDENCE' then anyw.m when 'MODEL_SPECIFIC_EVIDENCE_FAVORS_CANDIDATE' then u.m end recommended_candidate,
   case decision_class when 'EXACT_CONSENSUS' then ld.p when 'CALLER_SPECIFIC_WITH_STRONG_EVIDENCE' then anyw.p when 'MODEL_SPECIFIC_EVIDENCE_FAVORS_CANDIDATE' then u.p end recommended_provider,
   case when all_s then 'COMPARABLE_EVIDENCE_AVAILABLE' when miss then 'RESOURCE_UNAVAILABLE' else 'PARTIAL_EVIDENCE_AVAILABILITY' end evidence_comparability,
   case when decision_class = 'EXACT_CONSENSUS' then 'HIGH' when decision_class in ('CALLER_SPECIFIC_WITH_STRONG_EVIDENCE', 'MODEL_SPECIFIC_EVIDENCE_FAVORS_CANDIDATE') then 'MODERATE' else 'LOW' end gene_model_confidence from dec0)"""


def decided(spark, sf):
    """Members with their search result, joined once and written, and the decisions on their loci.  Records that aren't strong only count by their status.

    Loci of one row are decided where they are; the others are dealt by locus.
    """
    ev = candidate_evidence(spark, sf)
    strong = F.expr("supports and strength = 'STRONG'")
    ev = ev.select("model_id", "supports", "strength", F.expr(STATUS).alias("evidence_status"), *[F.when(strong, F.col(c)).alias(c) for c in ("source", "identifier", "description")])
    members = rc.locus_members(load(spark, sf, "sparse_models"), evidence=ev, alone=True)
    lone, rest = (members.where(c).drop("alone") for c in ("alone", "not alone"))
    decisions = rc.decide_loci(rc.locus_facts(rest), rest, rest).unionByName(rc.decide_loci(rc.locus_facts(lone, lone=True), lone, lone))
    return members.drop("alone"), decisions


@query("gm01_locus_decision", "sparse_models hits", f"with {DECISIONS} select component, decision_class, recommended_candidate, recommended_provider, evidence_comparability, gene_model_confidence from decs")
def gm01(spark, sf):
    return decided(spark, sf)[1].select("component", "decision_class", "recommended_candidate", "recommended_provider", "evidence_comparability", "gene_model_confidence")


SELECTION = f"""{DECISIONS}, leg as (select genome_id, component, arg_min(struct_pack(m := model_id, s := s, e := e, d := strand), (s, e, strand, model_id)) legacy from members where provider = 'phanotate' group by all),
 sel0 as (select d.*, legacy, r.s rs, r.e re, r.strand rd, coalesce(recommended_provider <> 'phanotate' and decision_class = 'MODEL_SPECIFIC_EVIDENCE_FAVORS_CANDIDATE' and evidence_comparability = 'COMPARABLE_EVIDENCE_AVAILABLE'
    and strand_status <> 'DISCORDANT' and reconciliation_class not in ('SPLIT_MODEL', 'MERGED_MODEL', 'COMPLEX_CONFLICT'), false) res
   from decs d left join leg using (genome_id, component) left join members r on r.model_id = d.recommended_candidate),
 sel1 as (select *, case when exact and candidate_count > 1 then 'EXACT_CONSENSUS_SELECTED' when res and reconciliation_class = 'COMMON_STOP_ALTERNATE_START' then 'EVIDENCE_RESOLVED_ALTERNATE_START'
   when res and reconciliation_class = 'COMMON_START_ALTERNATE_STOP' then 'EVIDENCE_RESOLVED_ALTERNATE_STOP' when reconciliation_class = 'CALLER_SPECIFIC' and legacy is null then 'RESCUE_CANDIDATE_NOT_AUTOMATICALLY_SELECTED'
   when reconciliation_class = 'STRAND_DISCORDANCE' then 'PHANOTATE_FALLBACK_STRAND_CONFLICT' when reconciliation_class in ('SPLIT_MODEL', 'MERGED_MODEL') then 'PHANOTATE_FALLBACK_SPLIT_MERGE'
   when reconciliation_class = 'COMPLEX_CONFLICT' then 'PHANOTATE_FALLBACK_COMPLEX_CONFLICT' when reconciliation_class in ('BOUNDARY_DISCORDANCE', 'COMMON_STOP_ALTERNATE_START', 'COMMON_START_ALTERNATE_STOP') then 'PHANOTATE_FALLBACK_BOUNDARY_UNRESOLVED'
   when legacy is not null then 'PHANOTATE_RETAINED_CALLER_SPECIFIC' else 'RESCUE_CANDIDATE_NOT_AUTOMATICALLY_SELECTED' end selection_rule from sel0),
 sel as (select component, selection_rule, case when selection_rule like 'EVIDENCE%' or (selection_rule like 'EXACT%' and legacy is null) then recommended_candidate else legacy.m end selected_candidate, legacy.m legacy_candidate,
   coalesce(selection_rule like 'EVIDENCE%' and legacy is not null and (rs, re, rd) <> (legacy.s, legacy.e, legacy.d), false) changed_from_legacy,
   not (selection_rule like 'EVIDENCE%' or selection_rule like 'EXACT%') review_required, not (selection_rule like 'EVIDENCE%' or selection_rule like 'EXACT%') and legacy is not null fallback_used,
   case when selection_rule like 'EVIDENCE%' then 'MODERATE' when selection_rule like 'EXACT%' then 'HIGH' else 'LOW' end confidence_class,
   case when strand_status = 'DISCORDANT' or reconciliation_class in ('SPLIT_MODEL', 'MERGED_MODEL', 'COMPLEX_CONFLICT') then 'HIGH_PRIORITY_REVIEW' when reconciliation_class = 'COMMON_STOP_ALTERNATE_START' then 'LOW_PRIORITY_REVIEW'
     when reconciliation_class in ('COMMON_START_ALTERNATE_STOP', 'BOUNDARY_DISCORDANCE', 'CALLER_SPECIFIC') or review_required then 'MODERATE_REVIEW' else 'NO_REVIEW' end review_priority from sel1)"""


def selected(spark, sf):
    members, decisions = decided(spark, sf)
    return members, rc.select_models(decisions, members)


@query("gm02_final_selection", "sparse_models hits", f"with {SELECTION} select * from sel")
def gm02(spark, sf):
    return selected(spark, sf)[1].drop("genome_id", "locus_id")


METRICS = {**rc.rules.SELECTION_RULES}
SUMMARY = " union all ".join(
    [f"select '{k}' metric, count(*) filter (where selection_rule = '{v}') count from sel" for k, v in METRICS.items()]
    + ["select 'total_loci', count(*) from sel", "select 'unchanged_phanotate', count(*) filter (where selected_candidate = legacy_candidate and not changed_from_legacy) from sel",
       "select 'review_required', count(*) filter (where review_required) from sel", "select 'changed_from_legacy', count(*) filter (where changed_from_legacy) from sel"]
    + [f"select '{t.lower()}', count(*) filter (where review_priority = '{t}') from sel" for t in rc.rules.REVIEW_TIERS])


@query("gm03_selection_summary", "sparse_models hits", f"with {SELECTION} {SUMMARY}")
def gm03(spark, sf):
    return rc.selection_summary(selected(spark, sf)[1])


@query("gm04_two_caller_adjudication", "sparse_models hits", f"""with {SIDES}, {EV}, sup as (select model_id, bool_or(supports and strength = 'STRONG') strong from ev where evalue <= 1e-5 group by 1),
 r as (select rec.*, coalesce(a.strong, false) ps, coalesce(b.strong, false) ds, a.model_id is not null and b.model_id is not null cmp from rec left join sup a on a.model_id = phanotate_id left join sup b on b.model_id = prodigal_id),
 t as (select *, phanotate_id is not null and prodigal_id is not null and not cmp and conflict_type <> 'EXACT_CONCORDANCE' thin, case when ps and not ds then 'PHANOTATE' when ds and not ps then 'PRODIGAL' end lead from r),
 u as (select *, case when thin then 'INSUFFICIENT_COMPARATIVE_EVIDENCE' when conflict_type = 'EXACT_CONCORDANCE' then 'CONCORDANT_EVIDENCE' when conflict_type in ('START_DISCORDANCE', 'STOP_DISCORDANCE') and lead is not null then 'PARTIALLY_CONCORDANT_EVIDENCE'
   when conflict_type = 'STRAND_DISCORDANCE' and lead is not null then 'CONCORDANT_EVIDENCE' when conflict_type = 'PRODIGAL_ONLY' and ds then 'CONCORDANT_EVIDENCE' else 'INSUFFICIENT_EVIDENCE' end adjudication_status from t)
select genome_id, phanotate_id, prodigal_id, conflict_type,
 case when thin then case when conflict_type like 'START%' then 'START_AMBIGUOUS' else 'START_NOT_COMPARABLE' end when conflict_type = 'EXACT_CONCORDANCE' then 'START_CONFIRMED' when conflict_type = 'START_DISCORDANCE' then coalesce('START_RESOLVED_' || lead, 'START_AMBIGUOUS') else 'START_NOT_COMPARABLE' end start_decision,
 case when thin then case when conflict_type like 'STOP%' then 'STOP_AMBIGUOUS' else 'STOP_NOT_COMPARABLE' end when conflict_type = 'EXACT_CONCORDANCE' then 'STOP_CONFIRMED' when conflict_type = 'STOP_DISCORDANCE' then coalesce('STOP_RESOLVED_' || lead, 'STOP_AMBIGUOUS') else 'STOP_NOT_COMPARABLE' end stop_decision,
 case when conflict_type = 'EXACT_CONCORDANCE' then 'STRAND_CONFIRMED' when not thin and conflict_type = 'STRAND_DISCORDANCE' and lead is not null then 'STRAND_SUPPORTS_' || lead else 'STRAND_AMBIGUOUS' end strand_decision,
 case when thin then 'PHANOTATE' when conflict_type = 'PRODIGAL_ONLY' then case when ds then 'PRODIGAL' else 'UNRESOLVED' end when conflict_type in ('START_DISCORDANCE', 'STOP_DISCORDANCE', 'STRAND_DISCORDANCE') then coalesce(lead, 'PHANOTATE') else 'PHANOTATE' end recommended_model,
 adjudication_status, conflict_type <> 'EXACT_CONCORDANCE' and adjudication_status like 'INSUFFICIENT%' manual_review from u""")
def gm04(spark, sf):
    support = candidate_evidence(spark, sf).where("evalue <= 1e-5").groupBy("model_id").agg(F.bool_or(F.expr("supports and strength = 'STRONG'")).alias("strong"))
    return rc.adjudicate_pair(rc.reconcile_pair(*callers(spark, sf)), support)


@query("gm05_gene_call_review", "sparse_models hits", f"""with {SIDES}, {EV}, acc as (select model_id, count(*) n, count(*) filter (where strength = 'STRONG') st, arg_min(source || ':' || identifier, (strength <> 'STRONG', evalue)) best from ev where supports group by 1),
 r as (select rec.*, coalesce(phanotate_id, prodigal_id) protein_id from rec), j as (select r.*, (m.e - m.s + 1) // 3 length_aa, coalesce(n, 0) n, coalesce(st, 0) st, best from r join sparse_models m on m.model_id = protein_id left join acc on acc.model_id = protein_id)
select genome_id, protein_id, phanotate_id, prodigal_id, conflict_type, length_aa, n accepted_evidence_count, st strong_evidence_count, coalesce(best, 'No accepted evidence') best_evidence,
 case when conflict_type = 'EXACT_CONCORDANCE' then 'HIGH' when conflict_type in ('START_DISCORDANCE', 'STOP_DISCORDANCE', 'START_AND_STOP_DISCORDANCE') then 'MODERATE' when conflict_type = 'STRAND_DISCORDANCE' then 'LOW' when st > 0 then 'MODERATE' else 'LOW' end gene_call_confidence,
 case when conflict_type = 'EXACT_CONCORDANCE' then 'NONE' when conflict_type in ('START_DISCORDANCE', 'STOP_DISCORDANCE', 'START_AND_STOP_DISCORDANCE') then 'REVIEW_BOUNDARIES' when conflict_type = 'STRAND_DISCORDANCE' then 'REVIEW_STRAND'
  when st = 0 and conflict_type = 'PHANOTATE_ONLY' and length_aa < 40 then 'POSSIBLE_FALSE_CALL' else 'REVIEW_CALLER_SPECIFIC' end review_flag from j""")
def gm05(spark, sf):
    lengths = load(spark, sf, "sparse_models").select("model_id", F.expr("(e - s + 1) div 3").alias("length_aa"))
    ev = candidate_evidence(spark, sf).withColumn("rank", F.col("evalue"))
    return rc.gene_call_review(rc.reconcile_pair(*callers(spark, sf)), ev, lengths)


@query("gm06_review_priority", "sparse_models hits", f"""with {SELECTION} select review_priority, count(*) loci from sel group by 1""")
def gm06(spark, sf):
    return selected(spark, sf)[1].groupBy("review_priority").agg(F.count("*").alias("loci"))


@query("gm07_rescue_ledger", "sparse_models hits", f"""with {SELECTION} select genome_id, component, model_id, provider from members where provider <> 'phanotate' and model_id not in (select selected_candidate from sel where selected_candidate is not null)""")
def gm07(spark, sf):
    members, picks = selected(spark, sf)
    return rc.final_trace(members.where("provider = 'phanotate'").select("genome_id", "model_id"), picks, members)[1]
