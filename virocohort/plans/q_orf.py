"""Queries over open reading frames and start models (OR01-OR14)."""

from pyspark.sql import functions as F

from virocohort.functions import sequence as sq
from virocohort.operators import intervals as iv
from virocohort.operators import orf
from virocohort.plans.q_sequence import CDS_SQL, RBS_SQL, RC, RESIDUES_SQL, calls_with_cds
from virocohort.plans.registry import query
from virocohort.plans.tables import load

STARTS = "('ATG','GTG','TTG','CTG','ATT','ATC','ATA')"
STOPS = "('TAA','TAG','TGA')"

# all (start, stop) pairs of both strands, written without windows
STARTS_SQL = f"""strands as (select genome_id, length(seq) n, '+' strand, seq st from contigs union all
   select genome_id, length(seq), '-', {RC.format('seq')} from contigs),
 cod as (select genome_id, n, strand, p, p % 3 fr, substr(st, p + 1, 3) k from strands, range(0, 2046) r(p) where p <= n - 3),
 ev as (select *, case when k in {STOPS} then 'stop' when k in {STARTS} then 'start' end kind from cod where k in {STOPS} or k in {STARTS}),
 bars as (select *, min(case when kind = 'stop' then p end) over (partition by genome_id, strand, fr order by p rows between 1 following and unbounded following) sp from ev),
 starts as (select genome_id, n, strand, k start_codon, p lft, sp + 3 rgt,
   case when strand = '+' then p + 1 else n - sp - 3 + 1 end s, case when strand = '+' then sp + 3 else n - p end e
   from bars where kind = 'start' and sp is not null),
 prim as (select genome_id, n, strand, rgt, min(lft) lft, genome_id || strand || rgt model_id from starts where rgt - lft >= 90 group by all),
 prim2 as (select *, case when strand = '+' then lft + 1 else n - rgt + 1 end s, case when strand = '+' then rgt else n - lft end e from prim),
 sec as (select * from starts where rgt - lft >= 90 and start_codon = 'ATG')"""


def starts_of(spark, sf, min_nt=90):
    return orf.stop_starts(load(spark, sf, "contigs"), min_nt)


def two_callers(spark, sf):
    """Primary caller: the longest ORF of each stop.  Second caller: every ATG start."""
    starts = starts_of(spark, sf)
    first = starts.groupBy("genome_id", "genome_length", "strand", "right").agg(F.min("left").alias("left"))
    s, e = sq.genomic(F.col("left"), F.col("right"), F.col("strand"), F.col("genome_length"))
    primary = first.select("genome_id", F.concat("genome_id", "strand", "right").alias("model_id"), "strand",
                           s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))
    return primary, starts.where("start_codon = 'ATG'").select("genome_id", "strand", "s", "e")


@query("or01_forward_orfs", "contigs", f"""
with {STARTS_SQL}, f as (select genome_id, p % 3 fr, p, case when k = 'ATG' then 'start' else 'stop' end kind from cod where strand = '+' and (k = 'ATG' or k in {STOPS})),
b as (select *, min(case when kind = 'stop' then p end) over (partition by genome_id, fr order by p rows between current row and unbounded following) sp from f),
o as (select genome_id, min(p) + 1 s, sp + 3 e from b where kind = 'start' and sp is not null group by genome_id, fr, sp)
select genome_id, 'PM_' || lpad((row_number() over (partition by genome_id order by s))::varchar, 6, '0') protein_id, s, e from o where e - s + 1 >= 90""")
def or01(spark, sf):
    return orf.forward_orfs(load(spark, sf, "contigs"))


@query("or02_stop_starts", "contigs", f"with {STARTS_SQL} select genome_id, strand, start_codon, s, e from starts where rgt - lft >= 90")
def or02(spark, sf):
    return starts_of(spark, sf).select("genome_id", "strand", "start_codon", "s", "e")


CONTEXT_SQL = f"""anch as (select p.* from prim2 p semi join sec using (genome_id, s, e, strand)),
 aw as (select genome_id, substr(st, (greatest(0, lft - 20) + 1)::bigint, greatest(0, lft - 4 - greatest(0, lft - 20))::bigint) win from anch join strands using (genome_id, strand)),
 {RBS_SQL.format('aw')},
 seen as (select genome_id, count(*) anchor_count, sum(case when rbs_score >= 8 then 1 else 0 end) hits from aw left join rbs using (win) group by 1),
 gc as (select genome_id, (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) gc_fraction from contigs)"""


@query("or03_start_context", "contigs", f"""
with {STARTS_SQL}, {CONTEXT_SQL}, t as (select *, greatest(0, least(1, (gc_fraction - 0.58) / 0.12)) t from gc left join seen using (genome_id))
select genome_id, round(gc_fraction, 6) gc_fraction, coalesce(anchor_count, 0) anchor_count, round(hits / anchor_count, 6) sd_prevalence,
 round(t * t * (3 - 2 * t), 6) adaptation,
 case when gc_fraction > 0.58 and anchor_count >= 10 and hits / anchor_count < 0.35 then 0.0::double else 1.0::double end sd_weight,
 coalesce(gc_fraction > 0.58 and anchor_count >= 10 and hits / anchor_count < 0.35, false) sd_sparse from t""")
def or03(spark, sf):
    primary, secondary = two_callers(spark, sf)
    out = orf.start_context(load(spark, sf, "contigs"), primary, secondary)
    return out.select("genome_id", F.round("gc_fraction", 6).alias("gc_fraction"), "anchor_count", F.round("sd_prevalence", 6).alias("sd_prevalence"),
                      F.round("adaptation", 6).alias("adaptation"), "sd_weight", "sd_sparse")


@query("or04_upstream_gap", "gene_models", """
with g as (select genome_id, strand, model_id, s lft, e rgt from gene_models),
best as (select c.model_id, max(struct_pack(a := g.lft, b := g.rgt)) m from g c join g on c.genome_id = g.genome_id and c.strand = g.strand and g.lft < c.lft and g.rgt < c.rgt group by 1)
select g.model_id, g.lft - m.b upstream_gap from g left join best using (model_id)""")
def or04(spark, sf):
    g = load(spark, sf, "gene_models").select("genome_id", "strand", "model_id", F.col("s").alias("left"), F.col("e").alias("right"))
    return orf.upstream_gap(g, g).select("model_id", "upstream_gap")


def scored(spark, sf):
    primary, secondary = two_callers(spark, sf)
    return primary, orf.candidate_starts(load(spark, sf, "contigs"), primary, secondary)


@query("or05_candidate_scores", "contigs", f"""
with {STARTS_SQL},
 cand as (select s.*, p.model_id, p.lft original_left from starts s join prim2 p using (genome_id, strand, rgt) where s.rgt - s.lft >= 90),
 prev as (select c.model_id, c.lft, max(struct_pack(a := g.lft, b := g.rgt)) m from cand c join prim2 g on c.genome_id = g.genome_id and c.strand = g.strand and g.lft < c.lft and g.rgt < c.rgt group by all),
 gap as (select c.*, c.lft - m.b gap, c.lft = original_left or c.start_codon = 'ATG' called, st,
   substr(st, (greatest(0, c.lft - 20) + 1)::bigint, greatest(0, c.lft - 4 - greatest(0, c.lft - 20))::bigint) win
   from cand c left join prev using (model_id, lft) join strands using (genome_id, strand)),
 {RBS_SQL.format('gap')},
 gc as (select genome_id, (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) gc from contigs),
 raw as (select *, coalesce(rbs_score, 0) raw_rbs,
   case when not called and gc > 0.58 and length(coalesce(motif, '')) < 5 then 0.25 * coalesce(rbs_score, 0) else coalesce(rbs_score, 0) end r,
   case when gap = -1 and substr(st, (greatest(0, lft - 2) + 1)::bigint, (lft + 3 - greatest(0, lft - 2))::bigint) in ('TAATG','TGATG','TAGTG','TATTG') then 4
        when gap = -4 and substr(st, (lft + 1)::bigint, 4) in ('ATGA','GTGA','TTGA') then 4 else 0 end cpl,
   greatest(0, least(1, (gc - 0.58) / 0.12)) t, case start_codon when 'ATG' then 3 when 'GTG' then 2 when 'TTG' then 1.5 else 0.5 end p0
   from gap left join rbs using (win) join gc using (genome_id)),
 pk as (select *, case when gap in (-1, -4) then cpl + case when cpl > 0 and raw_rbs > r then 2 else 0 end
     when gap between 0 and 15 then 3 when gap > 15 then -least(20, 0.5 * (gap - 15))
     when gap < -20 then -least(20, 0.15 * (-gap - 20)) * case when r >= 8 then 0.25 else 1 end else 0 end pack,
     case when start_codon in ('GTG', 'TTG') then p0 + t * t * (3 - 2 * t) * (3 - p0) * 0.8 else p0 end prior from raw)
select model_id, lft left_bound, start_codon, gap upstream_gap, round((prior + r + pack + case when called then 1.5 else 0 end)::double, 4) score from pk""")
def or05(spark, sf):
    _, rows = scored(spark, sf)
    return rows.select("model_id", F.col("left").alias("left_bound"), "start_codon", "upstream_gap", "score")


@query("or06_refine_starts")
def or06(spark, sf):
    primary, rows = scored(spark, sf)
    return orf.refine_starts(rows, primary)


OPTIONS = f"""{STARTS_SQL}, alt as (select s.* from sec s join strands st using (genome_id, strand)),
 opt as (select p.model_id, count(*) options, min(struct_pack(s := a.s, e := a.e)) alt from prim2 p join (select distinct genome_id, strand, s, e, rgt from alt) a
   using (genome_id, strand, rgt) group by 1)"""


@query("or07_same_stop_selection", "contigs", f"""
with {OPTIONS}
select genome_id, model_id, strand, p.s old_start, p.e old_end, case when options = 1 then alt.s else p.s end new_start,
 case when options = 1 then alt.e else p.e end new_end,
 case when options is null then 'no matching valid second-caller start - review' when options > 1 then 'ambiguous secondary starts - review'
      when alt.s = p.s and alt.e = p.e then 'AGREED_START' else 'SAME_STRAND_SAME_STOP_SECOND_CALLER_START' end outcome
from prim2 p left join opt using (model_id)""")
def or07(spark, sf):
    primary, secondary = two_callers(spark, sf)
    return orf.select_supported_starts(primary, secondary, load(spark, sf, "contigs"))


@query("or08_initiator_guard", "contigs", f"""
with {OPTIONS}, rare as (select p.*, substr(st, (lft + 1)::bigint, 3) start_codon from prim2 p join strands using (genome_id, strand)
   where substr(st, (lft + 1)::bigint, 3) in ('CTG','ATT','ATC','ATA')),
 ov as (select r.model_id, max(greatest(0, least(r.e, q.e) - greatest(r.s, q.s) + 1)) ov from rare r join prim2 q on r.genome_id = q.genome_id and r.strand = q.strand and r.model_id <> q.model_id group by 1),
 d as (select *, coalesce(ov, 0) same_strand_overlap_nt, case when coalesce(ov, 0) >= 100 then 'KEPT_OVERLAPPING_ARCHITECTURE_REVIEW'
   when coalesce(options, 0) <> 1 then 'KEPT_NO_UNIQUE_CANONICAL_CALLER_START' else 'RARE_INITIATOR_REPLACED_BY_CANONICAL_CALLER_START' end decision
   from rare left join ov using (model_id) left join opt using (model_id))
select genome_id, model_id, strand, start_codon, same_strand_overlap_nt, decision,
 case when decision like 'RARE%' then alt.s else s end new_start, case when decision like 'RARE%' then alt.e else e end new_end from d""")
def or08(spark, sf):
    primary, secondary = two_callers(spark, sf)
    return orf.initiator_guard(primary, secondary, load(spark, sf, "contigs"))


def long_genes(spark, sf):
    """Annotated genes for rescue tests: primary models of at least 180 bases."""
    primary, _ = two_callers(spark, sf)
    return primary.where("e - s + 1 >= 180")


@query("or09_short_orf_rescue")
def or09(spark, sf):
    genes = long_genes(spark, sf)
    rows = orf.rescue_candidates(load(spark, sf, "contigs"), genes)
    return orf.accept_short_orfs(rows, genes).select(
        "genome_id", "cand_id", "strand", "s", "e", "score", "uncovered", "gap_eligible", "eligible", "accepted", "review_reason")


NTERM = """select concat('C', cast(l_orderkey as varchar(20))) query, case when l_linenumber % 2 = 0 then 'Swiss-Prot' else 'PHROGs' end source,
 concat('T', cast(l_partkey as varchar(20)), '_', cast(l_suppkey as varchar(20))) target, 30 + 500 * l_discount pident,
 cast(60 + l_quantity as bigint) aln_len, cast(70 + l_quantity as bigint) qlen, cast(75 + l_quantity as bigint) slen,
 1 + l_linenumber % 3 qs, 1 + l_partkey % 3 ss, cast(concat('1e-', cast(cast(l_quantity as int) as varchar(10))) as double) evalue,
 l_extendedprice bits from {lineitem}"""


@query("or10_nterminal_anchors", "", f"""
with h as ({NTERM.format(lineitem='lineitem')}), g as (select * from h where pident >= 40 and evalue <= 1e-5 and qs <= 2 and ss <= 2 and aln_len / qlen >= 0.8 and aln_len / slen >= 0.8)
select query, target, source, bits from g qualify row_number() over (partition by query order by source = 'Swiss-Prot' desc, bits desc, target desc) = 1""")
def or10(spark, sf):
    return orf.homology_anchors(spark.sql(NTERM, lineitem=load(spark, sf, "lineitem")))


def prefiltered(spark, sf):
    """Short same-stop ORFs against longer genes; genes under 200 bases play the
    spanins, stops of ATG calls the family evidence."""
    genes = long_genes(spark, sf)
    starts = starts_of(spark, sf, 75).where("right - left <= 300")
    cands = starts.select("genome_id", F.concat_ws("|", "genome_id", "strand", "left", "right").alias("cand_id"), "strand", "s", "e",
                          (F.col("right") - F.col("left")).cast("double").alias("score"),
                          F.when(F.col("start_codon") == "GTG", 8.0).otherwise(0.0).alias("rbs_score"))
    spanins = genes.where("e - s + 1 < 200").select("model_id")
    stop = orf.biological_stop(F.col("s"), F.col("e"), F.col("strand"))
    families = starts.where("start_codon = 'ATG'").select("genome_id", "strand", stop.alias("stop")).distinct()
    return genes, cands, orf.overlap_prefilter(cands, genes, spanins, families)


@query("or11_overlap_prefilter", "contigs", f"""
with {STARTS_SQL}, genes as (select * from prim2 where e - s + 1 >= 180),
 c as (select *, genome_id || '|' || strand || '|' || lft || '|' || rgt cand_id, case when start_codon = 'GTG' then 8.0 else 0.0 end rbs_score from starts where rgt - lft between 75 and 300),
 pr as (select c.cand_id, c.strand = g.strand and (case when g.strand = '+' then c.s - g.s else g.e - c.e end) > 0
     and (case when g.strand = '+' then c.s - g.s else g.e - c.e end) % 3 <> 0 related, (case when g.strand = '+' then c.s - g.s else g.e - c.e end) % 3 = 1 one,
     g.e - g.s + 1 < 200 spanin from c join genes g on c.genome_id = g.genome_id and g.s <= c.e and g.e >= c.s),
 st as (select cand_id, bool_and(related) related, bool_and(related and one) plus_one, bool_or(spanin) spanin_context, count(*) outer_genes from pr group by 1),
 fam as (select distinct genome_id, strand, rgt from c where start_codon = 'ATG')
select c.cand_id, outer_genes, spanin_context, case when plus_one then 0 else 1 end policy_priority,
 case when rbs_score > 0 or spanin_context then 'RBS_OR_SPANIN' when fam.rgt is not null then 'FAMILY_EVIDENCE_EXCEPTION' else 'NO_INITIATION_OR_FAMILY_SUPPORT' end overlap_prefilter
from c join st using (cand_id) left join fam using (genome_id, strand, rgt) where related""")
def or11(spark, sf):
    _, _, rows = prefiltered(spark, sf)
    return rows.select("cand_id", "outer_genes", "spanin_context", "policy_priority", "overlap_prefilter")


@query("or12_overlap_promotion")
def or12(spark, sf):
    genes, cands, rows = prefiltered(spark, sf)
    label = lambda c: F.concat(F.lit("phrog_"), (F.col(c) % 97).cast("string"))
    families = cands.select("cand_id", F.lit("phrogs").alias("source"), label("s").alias("identifier"))
    near = iv.overlap_join(cands.select("genome_id", "cand_id", "s", "e"),
                           genes.select("genome_id", F.col("s").alias("gs"), F.col("e").alias("ge")), ["genome_id"], ("s", "e"), ("gs", "ge"))
    outer = near.select("cand_id", F.lit("phrogs").alias("source"), label("gs").alias("identifier")).distinct()
    used = genes.select("genome_id", "strand", orf.biological_stop(F.col("s"), F.col("e"), F.col("strand")).alias("stop")).distinct()
    # one RNA gene a contig
    rna = load(spark, sf, "supplier").select(F.concat(F.lit("G"), "s_suppkey").alias("genome_id"), (1 + F.col("s_suppkey") * 37 % 1900).alias("s"),
                                             (76 + F.col("s_suppkey") * 37 % 1900).alias("e"))
    return orf.promote_overlaps(rows, families, outer, cands.where("rbs_score >= 8").select("cand_id"), used, rna)


def flagged_calls(spark, sf):
    return load(spark, sf, "calls").select(
        "*", F.lit(False).alias("partial_5"), F.lit(False).alias("partial_3"), F.lit(1).alias("codon_start"))


REPAIR_SQL = f"""
with o as (select c.*, length(seq) n, case when strand = '-' then {RC.format('seq')} else seq end st,
   case when strand = '+' then s - 1 else length(seq) - e end l, case when strand = '+' then e else length(seq) - s + 1 end r from calls c join contigs using (genome_id)),
 a as (select *, (r - l) % 3 = 0 sound from o),
 b as (select *, sound and substr(st, (r - 2)::bigint, 3) not in {STOPS} no_stop,
   case when r + 3 <= n and substr(st, (r + 1)::bigint, 3) in {STOPS} then r + 3 when r + 6 <= n and substr(st, (r + 4)::bigint, 3) in {STOPS} then r + 6
        when r + 9 <= n and substr(st, (r + 7)::bigint, 3) in {STOPS} then r + 9 end ext from a),
 c as (select *, no_stop and ext is null p3, case when no_stop then coalesce(ext, case when n - r < 9 then n else r end) else r end r2,
   sound and substr(st, (l + 1)::bigint, 3) not in {STARTS} no_start from b),
 d as (select *, case when not no_start then null
   when l - 3 >= 0 and l + 3 <= r2 and substr(st, (l - 2)::bigint, 3) in {STARTS} and substr(st, (l - 2)::bigint, 3) not in {STOPS} then l - 3
   when l - 6 >= 0 and l <= r2 and substr(st, (l - 5)::bigint, 3) in {STARTS} and substr(st, (l - 2)::bigint, 3) not in {STOPS} then l - 6
   when l + 9 <= r2 and substr(st, (l + 4)::bigint, 3) in {STARTS} then l + 3 when l + 12 <= r2 and substr(st, (l + 7)::bigint, 3) in {STARTS} then l + 6 end moved from c),
 f as (select *, no_start and moved is null p5, coalesce(moved, l) l2 from d),
 g as (select *, case when p5 and l2 between 1 and 2 and l2 + 1 <= 3 then 1 + l2 else 1 end cs, case when p5 and l2 between 1 and 2 and l2 + 1 <= 3 then 0 else l2 end l3,
   case when p3 and n - r2 between 1 and 2 then n else r2 end r3 from f),
 h as (select *, case when strand = '+' then l3 + 1 else n - r3 + 1 end new_s, case when strand = '+' then r3 else n - l3 end new_e from g)
select genome_id, model_id, strand, s original_start, e original_end, new_s, new_e, p5 partial_5, p3 partial_3, cs::int codon_start,
   new_s <> s or new_e <> e or p5 or p3 or cs <> 1 repaired from h"""


@query("or13_boundary_repair", "calls contigs", REPAIR_SQL)
def or13(spark, sf):
    return orf.repair_boundaries(flagged_calls(spark, sf), load(spark, sf, "contigs"))


@query("or14_cds_problems", "calls contigs", f"""
with c as ({CDS_SQL}), t as (select *, {RESIDUES_SQL.format('cds')} tr from c), b as (select *, regexp_replace(tr, '\\*$', '') body from t)
select genome_id, model_id, concat_ws(';', case when substr(cds, 1, 3) not in {STARTS} then 'CDS_START_INVALID' end,
  case when right(cds, 3) not in {STOPS} then 'CDS_STOP_MISSING' end, case when length(cds) % 3 <> 0 then 'CDS_FRAME_INVALID' end,
  case when contains(body, '*') then 'CDS_INTERNAL_STOP_REVIEW_RECODING' end,
  case when substr(cds, 1, 3) in {STARTS} and body <> '' and substr(body, 1, 1) <> 'M' then 'CDS_TRANSLATION_MISMATCH' end) problems from b""")
def or14(spark, sf):
    calls = calls_with_cds(spark, sf).select(
        "genome_id", "model_id", "s", "e", "strand", "cds", sq.translate(F.col("cds")).alias("protein"),
        F.lit(False).alias("partial_5"), F.lit(False).alias("partial_3"), F.lit(1).alias("codon_start"))
    return orf.cds_problems(calls, load(spark, sf, "contigs"))
