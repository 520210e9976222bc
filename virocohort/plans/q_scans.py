"""Scan, sink and ingest queries (SC01-SC20, SK01-SK09, ST01-ST05).

Text is written by Spark from the supplied tables and read back by the scan under test, so each
query grows with the tables and is checked against the values that went in.
"""

from pyspark.sql import functions as F

from virocohort.functions import sequence as sq
from virocohort.operators import context as cx
from virocohort.operators import curation as cu
from virocohort.operators import evidence as ev
from virocohort.operators import families as fm
from virocohort.plans.q_evidence import TOPS
from virocohort.plans.q_sequence import CDS_SQL, PROTEIN_SQL, calls_with_cds
from virocohort.plans.q_orf import STARTS, STOPS
from virocohort.plans.registry import query
from virocohort.plans.tables import load
from virocohort.sources import scans as sc
from virocohort.sources import sinks as sk
from virocohort.streaming import ingest

TAB = "chr(9)"


def lines(spark, sf, table, expression):
    """Text rows rendered from a projection."""
    return load(spark, sf, table).select(F.expr(expression).alias("value"))


@query("sc01_fasta_scan", "contigs", "select genome_id record_id, length(seq) n, md5(seq) seq_md5, cast(null as varchar) reject_reason from contigs")
def sc01(spark, sf):
    text = load(spark, sf, "contigs").select(F.concat(F.lit(">"), "genome_id", F.lit(" phage\n"), F.regexp_replace(F.lower("seq"), "(.{80})", "$1\n")).alias("value"))
    return sc.parse_fasta(text).select("record_id", F.length("seq").alias("n"), F.md5("seq").alias("seq_md5"), "reject_reason")


@query("sc02_protein_fasta_scan", "hits", "select hit_id record_id, trim(regexp_replace(description, '\\s+', ' ', 'g')) description, case when aln_len % 7 = 0 then 'EMPTY_SEQUENCE' end reject_reason from hits")
def sc02(spark, sf):
    t = lines(spark, sf, "hits", "concat(hit_id, ' ', description, '\\n', if(aln_len % 7 = 0, '', 'MKV\\nLLA\\n'))")
    return sc.parse_fasta(t).select("record_id", "description", "reject_reason")


GFF = "concat_ws('\\t', genome_id, 'caller', if(e % 11 = 0, 'gene', 'CDS'), cast(s as string), cast(e as string), '.', strand, '0', concat('ID=', if(s % 5 = 0, '', model_id), ';product=', url_encode(concat(provider, ' gene; x=1')), if(s % 2 = 0, ';translation=MKV', '')))"


@query("sc04_gff_scan", "gene_models", """
select genome_id, s, e, strand, case when s % 5 = 0 then '' else model_id end model_id, provider || ' gene; x=1' product, case when s % 2 = 0 then sha256('MKV') end protein_sha256, cast(null as varchar) reject_reason from gene_models where e % 11 <> 0""")
def sc04(spark, sf):
    return sc.parse_gff(lines(spark, sf, "gene_models", GFF))


def genbank_records(spark, sf):
    """One record per genome; genes rendered in bins of the table's own genomes."""
    at = "if(strand = '-', concat('complement(', if(s % 9 = 0, '<', ''), cast(s as string), '..', cast(e as string), ')'), if(s % 13 = 0, concat('join(', cast(s as string), '..', cast(e as string), ',9..12)'), concat(cast(s as string), '..', if(e % 7 = 0, '>', ''), cast(e as string))))"
    gene = f"concat('     CDS             ', {at}, '\\n                     /locus_tag=\"', model_id, '\"\\n                     /product=\"tail fiber\\n                     ', provider, '\"\\n                     /translation=\"MKV\\n                     LLA\"')"
    return load(spark, sf, "calls").select(F.concat(F.lit("LOCUS       X 10 bp\nVERSION     "), "genome_id", F.lit(".1\nFEATURES             Location/Qualifiers\n     source          1..10\n"), F.expr(gene), F.lit("\nORIGIN\n        1 acgt")).alias("value"))


@query("sc05_genbank_scan", "calls", """
select genome_id || '.1' genome_id, s, e, strand, model_id, 'tail fiber ' || provider product, 'MKVLLA' translation from calls where strand = '-' or s % 13 <> 0""")
def sc05(spark, sf):
    return sc.parse_genbank(genbank_records(spark, sf))


DOM = "concat_ws('  ', identifier, 'PF1', '100', protein_id, '-', '200', cast(evalue as string), cast(bits as string), '0.1', '1', '1', '1e-3', if(aln_len % 13 = 0, 'bad', cast(evalue as string)), cast(bits as string), '0.0', '11', '90', '21', cast(20 + aln_len as string), '1', '200', '0.9', 'some  description')"


@query("sc06_domain_table_scan", "hits", "select identifier target, protein_id, evalue, bits score, round(aln_len / 200, 6) query_coverage, 0.8::double profile_coverage from hits where aln_len % 13 <> 0")
def sc06(spark, sf):
    d = sc.parse_domains(lines(spark, sf, "hits", DOM))
    return d.select("target", "protein_id", "evalue", "score", F.round("query_coverage", 6).alias("query_coverage"), "profile_coverage")


PROF = "concat_ws('\\t', protein_id, identifier, cast(identity as string), cast(aln_len as string), '1', '50', '100', '1', '60', '120', if(aln_len % 17 = 0, 'n/a', cast(evalue as string)), cast(bits as string), cast(query_coverage as string), '0.5')"


@query("sc07_profile_hits_scan", "hits", "select protein_id, identifier, round(identity, 6) identity, aln_len, case when aln_len % 17 = 0 then null else evalue end evalue, bits, round(query_coverage, 6) query_coverage, case when aln_len % 17 = 0 then 'INVALID_EVALUE' end reject_reason from hits")
def sc07(spark, sf):
    p = sc.parse_profile_hits(lines(spark, sf, "hits", PROF))
    return p.select("protein_id", "identifier", F.round("identity", 6).alias("identity"), "aln_len", "evalue", "bits", F.round("query_coverage", 6).alias("query_coverage"), "reject_reason")


PROT = "concat_ws('\\t', protein_id, if(aln_len % 2 = 0, concat('sp|', identifier, '|ENT_X'), identifier), cast(100 * identity as string), cast(aln_len as string), '80', '100', cast(aln_len as string), '1', '5', cast(5 + aln_len as string), cast(evalue as string), cast(bits as string))"


@query("sc08_protein_hits_scan", "hits", "select protein_id, identifier accession, aln_len, round(least(1, aln_len / 80), 6) query_coverage, round(least(1, (aln_len + 1) / 100), 6) subject_coverage, evalue, bits from hits")
def sc08(spark, sf):
    p = sc.parse_protein_hits(lines(spark, sf, "hits", PROT))
    return p.select("protein_id", "accession", "aln_len", F.round("query_coverage", 6).alias("query_coverage"), F.round("subject_coverage", 6).alias("subject_coverage"), "evalue", "bits")


FAMH = "concat_ws('\\t', protein_id, identifier, cast(if(aln_len % 2 = 0, 100 * identity, identity) as string), cast(aln_len as string), '80', '90', cast(evalue as string), cast(bits as string), '0.7', '0.6')"


@query("sc09_family_hits_scan", "hits", "select protein_id, identifier family_id, round(identity, 6) identity, aln_len, evalue, bits from hits")
def sc09(spark, sf):
    p = sc.parse_family_hits(lines(spark, sf, "hits", FAMH))
    return p.select("protein_id", "family_id", F.round("identity", 6).alias("identity"), "aln_len", "evalue", "bits")


@query("sc10_hsp_scan", "hsps", "select qs, qe, aln_len, nident, score from hsps")
def sc10(spark, sf):
    t = lines(spark, sf, "hsps", "concat_ws('\\t', cast(if(qs % 2 = 0, qs, qe) as string), cast(if(qs % 2 = 0, qe, qs) as string), cast(aln_len as string), cast(nident as string), cast(score as string))")
    return sc.parse_hsps(t).drop("reject_reason")


@query("sc10_gapped_hsp_scan", "hsps", """
select qs, qe, case when qs % 19 = 0 then 'SEQUENCE_LENGTHS_DIFFER' when qs % 23 = 0 then 'COORDINATES_OUT_OF_RANGE' when qs % 29 = 0 then 'SEQUENCE_COORDINATE_MISMATCH' end reject_reason from hsps""")
def sc10g(spark, sf):
    t = lines(spark, sf, "hsps", "concat_ws('\\t', cast(qs as string), cast(qe as string), cast(if(qs % 23 = 0, 5001, 100) as string), cast(if(qs % 23 = 0, 5001, 100) + aln_len - if(qs % 29 = 0, 0, 1) as string), cast(score as string), repeat('A', cast(aln_len as int)), repeat('A', cast(aln_len - if(qs % 19 = 0, 1, 0) as int)))")
    return sc.parse_gapped_hsps(t, F.lit(400), F.lit(5000)).select("qs", "qe", "reject_reason")


@query("sc11_sketch_distance_scan", "hits", "select identifier reference, protein_id sample_id, round(1 - identity, 6) distance, aln_len shared_hashes, 1000 sketch_size from hits")
def sc11(spark, sf):
    t = lines(spark, sf, "hits", "concat_ws('\\t', concat(identifier, ' some title'), protein_id, cast(1 - identity as string), '1e-9', concat(cast(aln_len as string), '/1000'))")
    return sc.parse_sketch_distances(t).select("reference", "sample_id", F.round("distance", 6).alias("distance"), "shared_hashes", "sketch_size")


FOLD = "concat_ws('\\t', protein_id, identifier, cast(identity as string), cast(if(aln_len % 31 = 0, 900, aln_len) as string), '100', '90', cast(query_coverage as string), cast(if(aln_len % 37 = 0, 1.5, subject_coverage) as string), cast(evalue as string), cast(if(aln_len % 41 = 0, -1, bits) as string), '0.5', '0.6')"
GROUPS = "select concat(lower(p_brand), '_', cast(p_size % 5 as varchar(10))) target, case when max(p_size) % 2 = 0 then 'phage' else 'bacteria' end as group from {p} where p_size > 8 group by 1 union all select concat(lower(p_brand), '_', '3'), 'other' from {p} where p_size = 3"


@query("sc12_structure_scan", "hits", f"""
with g0 as ({GROUPS.format(p='part').replace('as group', 'as "group"')}), g as (select target, min("group") lo, max("group") hi from g0 group by 1)
select protein_id query, identifier target, coalesce(lo, 'unknown') target_group, case when aln_len % 37 = 0 then 'FRACTION_OUTSIDE_0_1' when aln_len % 41 = 0 then 'NEGATIVE_SCORE' when aln_len % 31 = 0 then 'IMPLAUSIBLE_ALIGNMENT_LENGTH' when lo <> hi then 'CONFLICTING_TARGET_GROUP' end reject_reason from hits left join g on target = identifier""")
def sc12(spark, sf):
    groups = spark.sql(GROUPS.replace("as group", "as `group`"), p=load(spark, sf, "part"))
    return sc.parse_structure_hits(lines(spark, sf, "hits", FOLD), groups).select("query", "target", "target_group", "reject_reason")


@query("sc13_gene_call_scan", "gene_models", """
with m as (select *, case when e > 20100 then 'OUT_OF_RANGE' end reject_reason from gene_models)
select genome_id, s, e, strand, reject_reason, case when reject_reason is null then 'PM_' || lpad((row_number() over (partition by genome_id, reject_reason order by s, e, strand))::varchar, 6, '0') end model_id from m""")
def sc13(spark, sf):
    m = load(spark, sf, "gene_models").select("genome_id", F.expr("if(strand = '-', e, s)").alias("raw_start"), F.expr("if(strand = '-', s, e)").alias("raw_end"), F.lit(None).cast("string").alias("raw_strand"))
    lengths = load(spark, sf, "supplier").select(F.concat(F.lit("G"), "s_suppkey").alias("genome_id"), F.lit(20100).alias("genome_length"))
    return sc.gene_calls(m, lengths)


TRNA = "concat_ws('  ', genome_id, cast(s as string), cast(if(strand = '-', e, s) as string), cast(if(strand = '-', s, e) as string), if(e % 7 = 0, 'Undet', 'Ala'), 'TGC', if(e % 11 = 0, '5', '0'), if(e % 11 = 0, '9', '0'), '61.5', if(e % 13 = 0, 'pseudo', ''))"


@query("sc14_trna_scan", "calls", "select genome_id seqid, s, e, strand, case when e % 7 = 0 then 'tRNA-Undet' else 'tRNA-Ala' end product, case when e % 7 = 0 or e % 11 = 0 or e % 13 = 0 then 'INTRON_OR_UNCERTAIN_TRNA' end reject_reason from calls")
def sc14(spark, sf):
    return sc.parse_trna(lines(spark, sf, "calls", TRNA)).select("seqid", "s", "e", "strand", "product", "reject_reason")


@query("sc15_family_annotation", "hits", """
with a as (select p_size % 7 k, min(p_brand) c, min(p_name) d from part group by 1) select hit_id, c family_category, d family_description from hits left join a on k = aln_len % 9""")
def sc15(spark, sf):
    h = load(spark, sf, "hits").select("hit_id", F.expr("element_at(array('phrog_', 'PHROG', ''), cast(1 + aln_len % 3 as int)) || cast(aln_len % 9 as string)").alias("identifier"))
    a = load(spark, sf, "part").select(F.expr("concat('phrog_', cast(p_size % 7 as string))").alias("identifier"), F.col("p_brand").alias("category"), F.col("p_name").alias("description"))
    return sc.annotate_families(h, a).select("hit_id", "family_category", "family_description")


DAT = "concat('ID   ENT', cast(p_partkey as string), '_ECOLI   ', if(p_size % 3 = 0, 'Unreviewed;', 'Reviewed;'), ' 10 AA.\\nAC   A', cast(p_partkey as string), '; B1;\\nDE   RecName: Full=', p_name, ' {ECO:1};\\nGN   Name=g', cast(p_size as string), ';\\nOS   Phage ', p_brand, '.\\nOX   NCBI_TaxID=', cast(p_size as string), ';\\nPE   ', cast(p_size % 5 as string), ': x;\\nSQ   ')"


@query("sc16_curated_record_scan", "", "select 'A' || p_partkey accession, 'ENT' || p_partkey || '_ECOLI' entry_name, p_size % 3 <> 0 reviewed, p_name as \"name\", 'Phage ' || p_brand organism, p_size::varchar taxon_id, 'g' || p_size gene, (p_size % 5)::varchar existence from part")
def sc16(spark, sf):
    return sc.parse_curated(lines(spark, sf, "part", DAT))


@query("sc17_accession_cleanup", "", "select p_partkey, case p_size % 3 when 0 then 'NC_' || p_partkey when 1 then 'NC_' || p_partkey else p_name end accession from part")
def sc17(spark, sf):
    raw = "case p_size % 3 when 0 then concat('<a href=\"x\">NC_', cast(p_partkey as string), '</a>') when 1 then concat(' &lt;b&gt;NC_', cast(p_partkey as string), '&lt;/b&gt; ') else p_name end"
    return load(spark, sf, "part").select("p_partkey", sc.accession(F.expr(raw)).alias("accession"))


@query("sc18_evidence_json_scan", "hits proteins", """
select h.protein_id sample_id, case when aln_len % 40 = 0 then 'other' else p.genome_id end || '|' || h.protein_id cohort_protein_id, h.source, identifier from hits h join proteins p using (protein_id)""")
def sc18(spark, sf):
    h = load(spark, sf, "hits").join(load(spark, sf, "proteins").select("protein_id", "genome_id"), "protein_id")
    rec = F.struct(F.expr("if(aln_len % 40 = 0, 'other', genome_id)").alias("genome_id"), "protein_id", F.lit(1).alias("start"), F.array(F.struct("source", "identifier", "description")).alias("evidence"))
    files = h.groupBy(F.col("protein_id").alias("sample_id")).agg(F.to_json(F.collect_list(rec)).alias("value"))
    return sc.parse_evidence_json(files).select("sample_id", "cohort_protein_id", "source", "identifier")


COMP = "concat_ws('\\t', protein_id, identifier, if(aln_len % 11 = 0, 'alien', 'phage'), 'blastp', cast(identity as string), cast(query_coverage as string), if(aln_len % 13 = 0, '1.2', '0.9'))"


@query("sc19_comparison_scan", "hits", "select protein_id query, identifier target, case when aln_len % 11 = 0 then 'UNKNOWN_SOURCE_GROUP' when aln_len % 13 = 0 then 'FRACTION_OUTSIDE_0_1' end reject_reason from hits")
def sc19(spark, sf):
    return sc.parse_comparison(lines(spark, sf, "hits", COMP)).select("query", "target", "reject_reason")


LOCI = "select genome_id, case when s % 31 = 0 then 0 else s end s, e, case when e % 37 = 0 then '?' else strand end strand, case when s % 29 = 0 then 'join(1..2,3..4)' else '' end location, case when e % 41 = 0 then ' ' else 'cur' end curated_by from {m}"


@query("sc20_benchmark_loci", "sparse_models", f"""
with l as ({LOCI.format(m='sparse_models')}), d as (select *, count(*) over (partition by genome_id, s, e, strand) n from l)
select genome_id, s, e, strand, case when location <> '' then 'COMPOUND_LOCATION' when s < 1 then 'BAD_COORDINATES' when strand = '?' then 'BAD_STRAND' when trim(curated_by) = '' then 'MISSING_CURATOR' when n > 1 then 'DUPLICATE_LOCUS' end reject_reason from d""")
def sc20(spark, sf):
    return sc.benchmark_loci(spark.sql(LOCI, m=load(spark, sf, "sparse_models"))).select("genome_id", "s", "e", "strand", "reject_reason")


@query("sk01_flat_table", "classified", "select genome_id, protein_id, s::varchar s, coalesce(proposed_function, '') proposed_function, functional_state || ';' || confidence tags from classified")
def sk01(spark, sf):
    c = load(spark, sf, "classified").withColumn("tags", F.array("functional_state", "confidence"))
    return sk.flat_table(c, ["genome_id", "protein_id", "s", "proposed_function", "tags"])


@query("sk02_fasta_lines", "contigs", "select genome_id, sha256('>' || genome_id || chr(10) || rtrim(regexp_replace(seq, '(.{80})', '\\1' || chr(10), 'g'), chr(10))) text_sha from contigs")
def sk02(spark, sf):
    c = load(spark, sf, "contigs")
    f = sk.fasta_lines(c, F.col("genome_id"), "seq", 80)
    return f.select(F.regexp_extract("value", r"^>(\S+)", 1).alias("genome_id"), F.sha2("value", 256).alias("text_sha"))


EXPORT = "select genome_id, model_id, s, e, strand, s % 43 = 0 partial_5, e % 41 = 0 partial_3, cast(1 + s % 3 as int) codon_start, case when s % 2 = 0 then 'tail fiber; protein A/B' else null end product from {c}"


@query("sk03_gff_lines", "calls", f"""
with x as ({EXPORT.format(c='calls')}) select genome_id, concat_ws(chr(9), genome_id, 'virocohort', 'CDS', s, e, '.', strand, case when partial_5 then codon_start - 1 else 0 end, 'ID=' || model_id || ';product=' || coalesce(case when product is not null then 'tail%20fiber%3B%20protein%20A%2FB' end, '') || ';partial_5prime=' || partial_5 || ';partial_3prime=' || partial_3) "value" from x""")
def sk03(spark, sf):
    return sk.gff_lines(spark.sql(EXPORT, c=load(spark, sf, "calls")))


@query("sk04_feature_table", "calls", f"""
with x as ({EXPORT.format(c='calls')}), y as (select *, case when partial_5 then '<' else '' end || case when strand = '+' then s else e end a, case when partial_3 then '>' else '' end || case when strand = '+' then e else s end b from x),
 z as (select genome_id, model_id, list_filter([a || chr(9) || b || chr(9) || 'gene', repeat(chr(9), 3) || 'locus_tag' || chr(9) || model_id, a || chr(9) || b || chr(9) || 'CDS', repeat(chr(9), 3) || 'protein_id' || chr(9) || 'gnl|virocohort|' || model_id, repeat(chr(9), 3) || 'locus_tag' || chr(9) || model_id,
   repeat(chr(9), 3) || 'product' || chr(9) || coalesce(product, 'hypothetical protein'), repeat(chr(9), 3) || 'transl_table' || chr(9) || '11', case when partial_5 then repeat(chr(9), 3) || 'codon_start' || chr(9) || codon_start end], lambda v: v is not null) l from y)
select model_id, unnest(range(0, len(l))) line, unnest(l) "value" from z""")
def sk04(spark, sf):
    return sk.feature_table(spark.sql(EXPORT, c=load(spark, sf, "calls"))).select("model_id", "line", "value")


@query("sk05_orf_table", "calls contigs", f"""
with c as ({CDS_SQL}), p as (select *, {PROTEIN_SQL.format('cds')} protein, case when s % 2 = 0 then 'tail fiber' else 'hypothetical protein' end product from c)
select model_id locus_tag, length(cds) length_nt, length(protein) length_aa, substr(cds, 1, 3) start_codon, right(cds, 3) stop_codon, concat_ws(';', case when substr(cds, 1, 3) in ('CTG', 'ATT', 'ATC', 'ATA') then 'rare start codon - review' end, case when substr(cds, 1, 3) not in {STARTS} then 'unresolved_5prime' end,
 case when right(cds, 3) not in {STOPS} then 'unresolved_3prime' end, case when contains(protein, '*') then 'internal_stop_review_no_automatic_recoding' end, case when product = 'hypothetical protein' then 'no_supported_product' end) review_flag from p""")
def sk05(spark, sf):
    m = calls_with_cds(spark, sf).select("*", sq.translate(F.col("cds")).alias("protein"), F.lit(False).alias("partial_5"), F.lit(False).alias("partial_3"), F.expr("if(s % 2 = 0, 'tail fiber', 'hypothetical protein')").alias("product"))
    return sk.orf_table(m).select("locus_tag", "length_nt", "length_aa", "start_codon", "stop_codon", "review_flag")


@query("sk06_curation_workbook", "classified hits", f"""
with w as (select *, lag(protein_id) over o up, lead(protein_id) over o dn from classified window o as (partition by genome_id order by s, e, protein_id)), t as (select protein_id, {', '.join(f"arg_min(identifier || ' - ' || description, (evalue, hit_id)) filter (where source = '{s}') {n}_hit" for s, n in TOPS.items())} from hits group by 1)
select w.protein_id, proposed_function, functional_state, up upstream_id, dn downstream_id, case when functional_state = 'CONFLICTING_EVIDENCE' then 'HIGH' when functional_state = 'UNRESOLVED' then 'MEDIUM' end review_priority, case when s % 10 = 0 then 'KEPT' else '' end guard_decision, phrogs_hit, vogdb_hit, swissprot_hit from w left join t using (protein_id)""")
def sk06(spark, sf):
    c = load(spark, sf, "classified")
    genes = c.select("genome_id", "protein_id", "s", "e", "strand")
    context = cx.gene_order(genes).select("genome_id", "protein_id", "upstream_id", "downstream_id")
    empty = spark.sql("select genome_id, protein_id, 'NONE' review_flag from {c} where false", c=c)
    marks = spark.sql("select genome_id, 'x' hallmark, 'DETECTED' status from {c} where false", c=c)
    reviews = cu.review_queue(c.withColumn("ambiguity_flags", F.lit("")), empty, marks).withColumnRenamed("subject", "protein_id")
    guard = c.where("s % 10 = 0").select("protein_id", F.lit("KEPT").alias("guard_decision"))
    tops = ev.top_hits(load(spark, sf, "hits"), TOPS).select("protein_id", "phrogs_hit", "vogdb_hit", "swissprot_hit")
    wb = sk.curation_workbook(genes, c.select("genome_id", "protein_id", "proposed_function", "functional_state"), context, reviews, guard, tops)
    return wb.select("protein_id", "proposed_function", "functional_state", "upstream_id", "downstream_id", "review_priority", "guard_decision", "phrogs_hit", "vogdb_hit", "swissprot_hit")


@query("sk07_manifest_verification", "members", """
select coalesce(a.member_id, b.member_id) file, case when b.member_id is null then 'MISSING' when a.member_id is null then 'UNEXPECTED' else 'CHANGED' end problem
from (select * from members where n % 23 > 0) a full join (select *, case when n % 29 = 0 then 'x' else sha end s2 from members where n % 31 > 0) b using (member_id) where a.member_id is null or b.member_id is null or a.sha <> s2""")
def sk07(spark, sf):
    m = load(spark, sf, "members").select(F.col("member_id").alias("file"), F.col("sha").alias("sha256"), "n")
    return sk.verify_manifest(m.where("n % 23 > 0"), m.where("n % 31 > 0").withColumn("sha256", F.expr("if(n % 29 = 0, 'x', sha256)")))


@query("sk08_cohort_summary", "classified", "select genome_id, " + ", ".join(f"count(*) filter (where functional_state = '{s}') \"{s}\"" for s in sk.STATES) + " from classified group by 1")
def sk08(spark, sf):
    return sk.cohort_summary(load(spark, sf, "classified"))


@query("sk08_top_families", "classified", "select family_id, count(distinct genome_id) genome_count, count(*) member_count, row_number() over (order by count(distinct genome_id) desc, count(*) desc, family_id) rank from classified group by 1 qualify rank <= 50")
def sk08t(spark, sf):
    f = fm.cohort_families(load(spark, sf, "classified"))
    return fm.ranked(f, [F.desc("genome_count"), F.desc("member_count"), F.asc("family_id")], 50).select("family_id", "genome_count", "member_count", "rank")


@query("sk09_state_distribution", "classified", "select functional_state, count(*) count from classified group by 1")
def sk09(spark, sf):
    return sk.state_distribution(load(spark, sf, "classified"))


@query("sk09_heat_matrix", "classified", """
with f as (select family_id, count(distinct genome_id) g from classified group by 1), t as (select family_id from f where g > 1 order by family_id limit 80) select family_id, genome_id, count(*) copies from classified semi join t using (family_id) group by 1, 2""")
def sk09h(spark, sf):
    c = load(spark, sf, "classified")
    return sk.heat_rows(fm.cohort_families(c), fm.copies(c))


@query("sk09_recurrence_histogram", "classified", "select g genome_count, count(*) families from (select family_id, count(distinct genome_id) g from classified group by 1) group by 1")
def sk09r(spark, sf):
    return sk.recurrence_histogram(fm.cohort_families(load(spark, sf, "classified")))


@query("sk09_centred_neighbourhoods", "classified", "select genome_id occurrence, protein_id, s - min(s) over (partition by genome_id) x0, e - min(s) over (partition by genome_id) x1 from classified")
def sk09c(spark, sf):
    c = load(spark, sf, "classified").select(F.col("genome_id").alias("occurrence"), "protein_id", F.col("s").alias("start"), F.col("e").alias("end"))
    return sk.centred(c)


@query("sk11_protein_record", "classified", "select * from classified where genome_id = 'G' || (select min(o_custkey) from orders) and protein_id = (select min(protein_id) from classified where genome_id = 'G' || (select min(o_custkey) from orders))")
def sk11(spark, sf):
    c = load(spark, sf, "classified")
    genome = F.concat(F.lit("G"), load(spark, sf, "orders").agg(F.min("o_custkey")).scalar().cast("string"))
    first = c.where(F.col("genome_id") == genome).agg(F.min("protein_id")).scalar()
    return sk.protein_record(c, genome, first)


LANDED = "select source sample_id, md5(text) sha, n_chars > 60 usable from {d} where doc_id % 3 > 0"
KNOWN = "select source sample_id, md5(text) sha from {d} where doc_id % 3 = 0"


@query("st01_ingest_plan", "", f"""
with l as (select sample_id, sha, bool_and(usable) usable from ({LANDED.format(d='documents')}) group by 1, 2), r as ({KNOWN.format(d='documents')}), t as (select sample_id, count(*) taken from r group by 1), k as (select sha, min(sample_id) reused_from from r group by 1),
 x as (select l.*, reused_from, row_number() over (partition by l.sample_id order by l.sha) + coalesce(taken, 0) p from l left join t using (sample_id) left join k using (sha))
select case when p > 1 then sample_id || '_' || p else sample_id end sample_id, sha, case when reused_from is not null then 'REUSED' when not usable then 'FAILED' else 'SUCCESS' end state, reused_from from x""")
def st01(spark, sf):
    d = load(spark, sf, "documents")
    return ingest.plan_samples(spark.sql(LANDED, d=d), spark.sql(KNOWN, d=d))


@query("st04_state_summary", "", """
select event_type stage, count(*) filter (where value > 20) "SUCCESS", count(*) filter (where value between 5 and 20) "REUSED", count(*) filter (where value < 5) "FAILED" from events group by 1""")
def st04(spark, sf):
    s = load(spark, sf, "events").select(F.col("event_type").alias("stage"), F.expr("case when value > 20 then 'SUCCESS' when value < 5 then 'FAILED' else 'REUSED' end").alias("state"))
    return ingest.state_summary(s)


@query("st05_segment_rollup", "sparse_models", """
with m as (select genome_id, strand || provider segment_id, e, md5((e - s)::varchar) sha from sparse_models), p as (select genome_id, segment_id, count(*) models, max(e) last_base from m group by 1, 2), w as (select genome_id, count(distinct segment_id) segments, count(distinct sha) unique_proteins, count(*) genome_models from m group by 1) select * from p join w using (genome_id)""")
def st05(spark, sf):
    m = load(spark, sf, "sparse_models").select("genome_id", F.concat("strand", "provider").alias("segment_id"), "e", F.md5((F.col("e") - F.col("s")).cast("string")).alias("sha"))
    return ingest.segment_rollup(m)
