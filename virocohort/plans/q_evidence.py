"""Label and evidence queries (TX01-TX12, EV01-EV18)."""

from pyspark.sql import functions as F

from virocohort.functions import labels as lb
from virocohort.operators import evidence as ev
from virocohort.plans.registry import query
from virocohort.plans.tables import load
from virocohort.rules import fusion as rules

# names in many spellings, from part names and sizes
NAMES = """select p_partkey k, case p_size % 12 when 0 then p_name when 1 then concat('Putative ', p_name, ' protein') when 2 then concat('gp', cast(p_size as varchar(9)))
  when 3 then 'hypothetical protein' when 4 then concat('RefSeq ', upper(p_name), '  kinase') when 5 then concat('protein ORF', cast(p_partkey as varchar(9))) when 6 then 'DUF4432 domain'
  when 7 then concat('Probable ', p_name, ' {{ECO:0000305}}') when 8 then 'major head protein' when 9 then concat('terminase ', p_name, ' gp', cast(p_size as varchar(9)))
  when 10 then 'Rz1-like  spanin' else 'conserved phage protein of unknown function' end product,
  case p_partkey % 7 when 0 then p_name when 1 then concat(p_name, ' protein') when 2 then 'hypothetical protein' when 3 then 'major capsid protein' when 4 then 'hypothetical protein containing kinase fold'
  when 5 then concat('terminase ', p_name) else 'Rz1 spanin' end reference from {part}"""
N = f"n as ({NAMES.format(part='part')})"


def names(spark, sf):
    return spark.sql(NAMES, part=load(spark, sf, "part"))


def sq_list(values):
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


IDENT = lb.IDENTIFIER_ONLY
ident_sql = lambda c: f"regexp_matches(regexp_replace(regexp_replace(lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))), '{lb.HEDGES}', ''), '{lb.PROPHAGE}', ''), '{IDENT}')"
canon_sql = lambda c: "case " + c + " " + " ".join(f"when '{k}' then '{v}'" for k, v in rules.CANONICAL.items()) + f" else {c} end"
strip_sql = lambda c: (f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '^refseq\\s+', ''), '^sp\\|[^|]+\\|', ''), "
                       f"'^[a-z0-9]+_[a-z0-9]+\\s+', ''), '\\s*\\{{eco:[^}}]+\\}}\\s*$', ''))")


def norm_sql(c: str) -> str:
    t = strip_sql(c)
    return (f"case when not regexp_matches({t}, '\\b(?:hypothetical|uncharacterized|uncharacterised)\\b') and not regexp_matches({t}, '\\b(?:duf\\d+|upf\\d+)\\b|\\b(?:domain|protein|family) of unknown function\\b') "
            f"and not {ident_sql(t)} and {canon_sql(t)} not in {sq_list(rules.UNKNOWN_LABELS)} then {canon_sql(t)} end")


prod_sql = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
hist_sql = lambda c: f"({prod_sql(c)} <> '' and not regexp_matches({prod_sql(c)}, '{lb.UNNAMED}') and {prod_sql(c)} not in {sq_list(lb.BARE_NAMES)})"
inf_sql = lambda c: f"({hist_sql(c)} and not {ident_sql(c)} and {prod_sql(c)} not in ('na', 'n a', 'nan', 'none', 'null') and not regexp_matches({prod_sql(c)}, '\\b(duf\\d*|upf\\d*)\\b'))"


@query("tx01_normalise_function", "", f"with {N} select k, {norm_sql('product')} label from n")
def tx01(spark, sf):
    return names(spark, sf).select("k", lb.normalise_function(F.col("product")).alias("label"))


@query("tx02_identifier_only", "", f"with {N} select k, {ident_sql('product')} identifier_only from n")
def tx02(spark, sf):
    return names(spark, sf).select("k", lb.identifier_only(F.col("product")).alias("identifier_only"))


@query("tx03_informative", "", f"with {N} select k, {hist_sql('product')} historical, {inf_sql('product')} current_policy from n")
def tx03(spark, sf):
    return names(spark, sf).select("k", lb.informative_historical(F.col("product")).alias("historical"), lb.informative(F.col("product")).alias("current_policy"))


@query("tx04_sanitise_product", "", f"""
with {N}, a as (select k, trim(regexp_replace(product, '\\s+', ' ', 'g')) t from n),
b as (select *, regexp_replace(regexp_replace(t, '\\s*\\{{ECO:[^}}]*\\}}', '', 'g'), '{lb.PRODUCT_ID}', '', 'g') c from a),
c as (select *, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(c, '\\(\\s*\\)', '', 'g'), '\\s+', ' ', 'g')), '^[ ,;:-]+', ''), '[ ,;:-]+$', ''), '(?i)^probable\\b', 'putative') d from b)
select k, case when t = '' or regexp_matches(t, '(?i)\\b(hypothetical|uncharacteri[sz]ed|unknown|unnamed)\\b') or regexp_matches(d, '^(?:[a-z]{{2,3}}[A-Z][0-9]?|[A-Z][a-z]{{2}}[A-Z]?)$') or lower(d) in {sq_list(lb.VAGUE_PRODUCTS)}
  then 'hypothetical protein' else d end product from c""")
def tx04(spark, sf):
    return names(spark, sf).select("k", lb.sanitise_product(F.col("product")).alias("product"))


@query("tx05_unresolved_label", "", f"""
with {N} select k, lower(trim(product)) = '' or regexp_matches(lower(trim(product)), '^(hypothetical protein|unknown protein|uncharacterized protein|uncharacterised protein|protein of unknown function)( |$)') unresolved from n""")
def tx05(spark, sf):
    return names(spark, sf).select("k", lb.unresolved(F.col("product")).alias("unresolved"))


rel_sql = lambda c: (f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '\\b(putative|probable|predicted)\\b', '', 'g'), '\\bmajor head protein\\b', 'major capsid protein', 'g'), "
                     f"'\\bterminase protein\\b', 'terminase', 'g'), '[^a-z0-9]+', ' ', 'g'))")
REL = f"""r as (select *, {rel_sql('product')} a, {rel_sql('reference')} b from n),
 u as (select *, a = '' or a in {sq_list(lb.UNRESOLVED_NAMES)} ua, b = '' or b in {sq_list(lb.UNRESOLVED_NAMES)} ub from r)"""


@query("tx06_product_relation", "", f"""
with {N}, {REL} select k, case when a = b and a <> '' then 'EXACT_PRODUCT_AGREEMENT' when ua and ub then 'BOTH_FUNCTION_UNKNOWN'
 when lower(product) like 'hypothetical protein containing %' and ub then 'LEFT_DOMAIN_INFORMATION_ONLY' when lower(reference) like 'hypothetical protein containing %' and ua then 'RIGHT_DOMAIN_INFORMATION_ONLY'
 when ua then 'RIGHT_FUNCTIONALLY_MORE_INFORMATIVE' when ub then 'LEFT_FUNCTIONALLY_MORE_INFORMATIVE' else 'GENUINE_FUNCTIONAL_DISAGREEMENT' end relation from u""")
def tx06(spark, sf):
    return names(spark, sf).select("k", lb.product_relation(F.col("product"), F.col("reference")).alias("relation"))


SYNONYMS = """select concat('R', cast(r_regionkey as varchar(9))) rule_id, case r_regionkey when 0 then 'major head protein' when 1 then 'Rz1-like spanin' when 2 then 'head tail connector' when 3 then 'tape measure protein' else 'holin' end term_a,
 case r_regionkey when 0 then 'Major capsid protein' when 1 then 'Rz1 spanin' when 2 then 'neck protein' when 3 then 'tape measure' else 'protein' end term_b,
 case when r_regionkey = 3 then '' else 'same gene family' end rationale from {region}"""
SYN = f"sy as ({SYNONYMS.format(region='region')}), syn as (select {prod_sql('term_a')} a, {prod_sql('term_b')} b from sy union select {prod_sql('term_b')}, {prod_sql('term_a')} from sy)"


def synonyms(spark, sf):
    return spark.sql(SYNONYMS, region=load(spark, sf, "region"))


@query("sc21_synonym_gate", "", f"""with {SYN} select rule_id, case when not {hist_sql('term_a')} or not {hist_sql('term_b')} or trim(rationale) = '' then 'UNINFORMATIVE_TERM_OR_NO_RATIONALE' end reason from sy
 where not {hist_sql('term_a')} or not {hist_sql('term_b')} or trim(rationale) = ''""")
def sc21(spark, sf):
    return lb.synonym_problems(synonyms(spark, sf))


CATEGORY = f"""case when not {inf_sql('reference')} then 'NON_EVALUABLE_REFERENCE' when not {inf_sql('product')} then 'ABSTENTION' when {prod_sql('product')} = {prod_sql('reference')} then 'EXACT_PRODUCT_AGREEMENT'
  when exists (select 1 from syn where a = {prod_sql('product')} and b = {prod_sql('reference')}) then 'EQUIVALENT_FUNCTION' else 'UNRESOLVED_REVIEW_REQUIRED' end"""


@query("tx07_concordance_category", "", f"with {N}, {SYN} select k, {CATEGORY} category from n")
def tx07(spark, sf):
    return lb.concordance(names(spark, sf), "product", "reference", lb.synonym_pairs(synonyms(spark, sf))).select("k", "category")


@query("tx08_token_adjudication", "", f"""
with {N}, t as (select *, {prod_sql('product')} p, {prod_sql('reference')} r from n),
l as (select *, list_distinct(string_split(p, ' ')) pt, list_distinct(string_split(r, ' ')) rt from t), o as (select *, len(list_intersect(pt, rt)) b, len(list_distinct(list_concat(pt, rt))) u from l)
select k, case when regexp_matches(reference, '{lb.NOT_INFORMATIVE}') then 'NOT_EVALUABLE' when p = '' or regexp_matches(product, '{lb.NOT_INFORMATIVE}') then 'UNRESOLVABLE'
 when p = r or (p in ('major head protein', 'major capsid protein') and r in ('major head protein', 'major capsid protein')) then 'CORRECT' when b = len(pt) and len(pt) < len(rt) then 'TOO_GENERAL'
 when b / greatest(1, u) >= 0.5 and k % 2 = 0 and k % 5 <> 0 then 'PARTIALLY_CORRECT' else 'UNRESOLVABLE' end judgment from o""")
def tx08(spark, sf):
    return names(spark, sf).select("k", lb.token_adjudication(F.col("product"), F.col("reference"), F.col("k") % 2 == 0, F.col("k") % 5 == 0).alias("judgment"))


@query("tx09_canonical_spanin", "", f"""
with {N}, t as (select k, trim(regexp_replace(product, '\\s+', ' ', 'g')) t from n) select k, case when regexp_matches(t, '(?i)^rz(?:-like)? spanin$') then 'Rz-like spanin' when regexp_matches(t, '(?i)^rz1(?:-like)? spanin$') then 'Rz1-like spanin' else t end product from t""")
def tx09(spark, sf):
    return names(spark, sf).select("k", lb.canonical_spanin(F.col("product")).alias("product"))


has_sql = lambda c, words: "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query("tx10_module_hallmark_keywords", "hits", f"""
with t as (select hit_id, lower(description) d from hits), m as (select hit_id, d, list_filter([{', '.join(f"case when {has_sql('d', w)} then '{k}' end" for k, w in rules.MODULES.items())}], lambda x: x is not null) ms,
 list_filter([{', '.join(f"case when {has_sql('d', w)} then '{k}' end" for k, w in rules.HALLMARKS.items())}], lambda x: x is not null) hs from t)
select hit_id, case when len(ms) = 1 then ms[1] end signal, array_to_string(hs, ';') hallmarks from m""")
def tx10(spark, sf):
    d = F.lower("description")
    return load(spark, sf, "hits").select("hit_id", lb.module_signal(d).alias("signal"), F.array_join(lb.hallmark_matches(d), ";").alias("hallmarks"))


@query("tx11_named_product_yield", "hits", """
select source, count(*) predictions, count(*) filter (where trim(description) <> '' and not regexp_matches(lower(description), 'hypothetical|unknown|uncharacteri[sz]ed|unnamed|no annotation')) named from hits group by 1""")
def tx11(spark, sf):
    return load(spark, sf, "hits").groupBy("source").agg(F.count("*").alias("predictions"), F.count_if(lb.named_product(F.col("description"))).alias("named"))


# one E-value and coverage set for the policies
@query("ev01_domain_policy", "hits", """
select hit_id, 'STRONG' ga, 'WEAK' none_mode, case when evalue > 1e-5 or query_coverage < 0.5 then 'REJECTED' else 'STRONG' end manual, case when evalue > 1e-5 then 'REJECTED' else 'WEAK' end evalue_only from hits where source = 'Pfam'""")
def ev01(spark, sf):
    h = load(spark, sf, "hits").where("source = 'Pfam'")
    e, c = F.col("evalue"), F.col("query_coverage")
    return h.select("hit_id", ev.domain_policy(e, c).alias("ga"), ev.domain_policy(e, c, "NONE").alias("none_mode"),
                    ev.domain_policy(e, c, "MANUAL", 1e-5, 0.5).alias("manual"), ev.domain_policy(e, c, "MANUAL", 1e-5).alias("evalue_only"))


@query("ev02_orthology_policy", "hits", "select hit_id, case when evalue > 1e-5 or query_coverage < 0.5 then 'REJECTED' else 'STRONG' end strength from hits where source = 'VOGDB'")
def ev02(spark, sf):
    return load(spark, sf, "hits").where("source = 'VOGDB'").select("hit_id", ev.orthology_policy(F.col("evalue"), F.col("query_coverage")).alias("strength"))


@query("ev03_homology_policy", "hits", """
select hit_id, case when evalue > 1e-5 or aln_len < 30 then 'REJECTED' when identity >= 0.7 and query_coverage >= 0.7 and subject_coverage >= 0.7 then 'STRONG'
 when identity >= 0.35 and query_coverage >= 0.4 and subject_coverage >= 0.4 then 'MODERATE' else 'REJECTED' end strength from hits where source = 'Swiss-Prot'""")
def ev03(spark, sf):
    c = [F.col(x) for x in ("identity", "query_coverage", "subject_coverage", "evalue", "aln_len")]
    return load(spark, sf, "hits").where("source = 'Swiss-Prot'").select("hit_id", ev.homology_policy(*c).alias("strength"))


@query("ev04_phage_orthology_policy", "hits", f"""
select hit_id, case when evalue > 1e-5 or query_coverage < 0.5 or bits < 30 then 'REJECTED' else 'STRONG' end strength, case when lower(trim(description)) not in {sq_list(rules.UNKNOWN_LABELS)} then description end description from hits where source = 'PHROGs'""")
def ev04(spark, sf):
    s = ev.phage_orthology_policy(evalue=(F.col("evalue"), 1e-5), coverage=(F.col("query_coverage"), 0.5), score=(F.col("bits"), 30))
    return load(spark, sf, "hits").where("source = 'PHROGs'").select("hit_id", s.alias("strength"), ev.known_function(F.col("description")).alias("description"))


STRENGTHS = """case when source = 'Swiss-Prot' then case when evalue > 1e-5 or aln_len < 30 then 'REJECTED' when identity >= 0.7 and query_coverage >= 0.7 and subject_coverage >= 0.7 then 'STRONG'
   when identity >= 0.35 and query_coverage >= 0.4 and subject_coverage >= 0.4 then 'MODERATE' else 'REJECTED' end when evalue > 1e-5 or query_coverage < 0.5 then 'REJECTED' else 'STRONG' end"""


def classified_hits(spark, sf):
    """All hits with the policy of their source applied (EV01-EV04)."""
    h = load(spark, sf, "hits")
    e, c = F.col("evalue"), F.col("query_coverage")
    swiss = ev.homology_policy(F.col("identity"), c, F.col("subject_coverage"), e, F.col("aln_len"))
    strength = (
        F.when(F.col("source") == "Swiss-Prot", swiss).when(F.col("source") == "VOGDB", ev.orthology_policy(e, c))
        .when(F.col("source") == "Pfam", ev.domain_policy(e, c, "MANUAL", 1e-5, 0.5)).otherwise(ev.phage_orthology_policy(evalue=(e, 1e-5), coverage=(c, 0.5)))
    )
    return h.withColumn("strength", strength).withColumn("supports", F.col("strength") != "REJECTED")


CH = f"ch as (select *, {STRENGTHS} strength, {STRENGTHS} <> 'REJECTED' supports from hits)"

BACKENDS = "select protein_id, identifier, case when bits >= 100 then 'mmseqs' else 'pyhmmer' end backend, evalue <= 1e-5 supports, hit_id seq, description, bits from {hits}"


@query("ev05_backend_merge", "hits", f"""
with b as ({BACKENDS.format(hits='hits')}), a as (select protein_id, identifier, string_agg(distinct backend, ';' order by backend) search_backends, count(*) - 1 corroborating_hits from b group by 1, 2),
f as (select * from b qualify row_number() over (partition by protein_id, identifier order by not supports, seq) = 1)
select protein_id, identifier, backend, supports, description, bits, search_backends, corroborating_hits from f join a using (protein_id, identifier)""")
def ev05(spark, sf):
    return ev.merge_backends(spark.sql(BACKENDS, hits=load(spark, sf, "hits")))


@query("ev06_conflict_marking", "hits", f"""
with {CH}, c as (select protein_id, source, count(distinct description) > 1 conflict from ch where case when source = 'PHROGs' then supports and strength = 'STRONG' else supports end group by 1, 2)
select hit_id, coalesce(conflict, false) conflict from ch left join c using (protein_id, source)""")
def ev06(spark, sf):
    return ev.mark_conflicts(classified_hits(spark, sf)).select("hit_id", "conflict")


@query("ev07_family_support", "hits", f"with {CH} select hit_id from ch where source in ('PHROGs', 'VOGDB') and supports and evalue <= 1e-5 and query_coverage between 0.7 and 1")
def ev07(spark, sf):
    return ev.family_support(classified_hits(spark, sf)).select("hit_id")


MARKER_TEXT = "concat(description, case when hit_id like '%_1_%' then ' antitoxin' when hit_id like '%_2_%' then ' shiga anti-toxin' when hit_id like '%_3_%' then ' beta-lactamase' else '' end)"


@query("ev08_text_markers", "hits", f"""
with {CH}, t as (select hit_id, {MARKER_TEXT} x from ch where supports)
select hit_id, 'lysogeny' category from t where regexp_matches(x, '{rules.SAFETY_PATTERNS["lysogeny"]}')
union all select hit_id, 'toxin_virulence' from t where regexp_matches(x, '{rules.SAFETY_PATTERNS["toxin_virulence"]}') and not (regexp_matches(x, '(?i)\\banti[- ]?toxin\\b') and not regexp_matches(x, '(?i)\\b(?:shiga|entero|exo|cyto)toxin\\b'))
union all select hit_id, 'amr' from t where regexp_matches(x, '{rules.SAFETY_PATTERNS["amr"]}')""")
def ev08(spark, sf):
    h = classified_hits(spark, sf).where("supports").withColumn("x", F.expr(MARKER_TEXT))
    return ev.text_markers(h, F.col("x")).select("hit_id", "category")


SCREEN = "select hit_id, case source when 'Pfam' then 'amr' when 'VOGDB' then 'lysogeny' else 'toxin_virulence' end category, 100 * identity pident, query_coverage qcov, subject_coverage scov, evalue from {hits}"


@query("ev09_similarity_screen", "hits", f"with s as ({SCREEN.format(hits='hits')}) select hit_id, category, 'toxin_virulence' not_searched from s where pident >= 40 and least(qcov, scov) >= 0.8 and evalue <= 1e-5 and category in ('amr', 'lysogeny')")
def ev09(spark, sf):
    good, absent = ev.similarity_screen(spark.sql(SCREEN, hits=load(spark, sf, "hits")), ["amr", "lysogeny"])
    return good.select("hit_id", "category", F.lit(",".join(absent)).alias("not_searched"))


# a search over distinct document texts plays the expensive homology search
def occurrences(spark, sf):
    return load(spark, sf, "members").select(F.col("member_id").alias("protein_id"), "genome_id", "sha", "n_chars", "n")


@query("ev10_search_once", "members", """
with r as (select sha, min(member_id) rep, count(*) occurrences from members group by 1), h as (select r.sha, 'F' || (n_chars % 50) identifier, occurrences from r join members m on m.member_id = r.rep)
select m.member_id protein_id, genome_id, identifier, occurrences from members m join h using (sha)""")
def ev10(spark, sf):
    p = occurrences(spark, sf)
    reps = ev.representatives(p).join(p.select("protein_id", "n_chars"), "protein_id")
    hits = reps.select("sha", F.concat(F.lit("F"), F.col("n_chars") % 50).alias("identifier"), "occurrences")
    return ev.copy_to_occurrences(hits, p).select("protein_id", "genome_id", "identifier", "occurrences")


@query("ev11_incremental_cache", "members", """
with old as (select distinct sha from members where host_genus in ('en', 'fr')), neu as (select distinct sha from members where sha not in (select sha from old)),
hit as (select sha, min(n_chars) c from members group by 1)
select sha, case when c % 3 > 0 then 'F' || (c % 50) end identifier, sha in (select sha from old) was_cached from hit""")
def ev11(spark, sf):
    p = load(spark, sf, "members")
    hit = p.groupBy("sha").agg(F.min("n_chars").alias("c")).where("c % 3 > 0").select("sha", F.concat(F.lit("F"), F.col("c") % 50).alias("identifier"), F.lit(1e-9).alias("evalue"))
    empty = spark.createDataFrame([], "sha string, identifier string, evalue double, fingerprint string, digest string")
    first = ev.updated_cache(empty, p.where("host_genus in ('en', 'fr')"), hit, "adapter-1")
    todo = ev.missing_searches(p, first, "adapter-1")
    full = ev.updated_cache(first.withColumn("o", F.lit(1)).drop("o"), todo, hit, "adapter-1")
    return full.select("sha", "identifier").join(todo.withColumn("t", F.lit(True)), "sha", "left").select("sha", "identifier", F.col("t").isNull().alias("was_cached"))


@query("ev12_evidence_fan_out", "members", """
with h as (select sha, count(*) hits from (select distinct sha, n_chars % 5 f from members where n_chars % 4 > 0) group by 1),
s as (select sha, case when min(host_genus) = 'de' then 'UNAVAILABLE' when min(host_genus) = 'fr' then 'CACHED' else 'EXECUTED' end state from members group by 1)
select member_id model_id, m.sha, 'phrogs' adapter, case when state = 'UNAVAILABLE' then 'RESOURCE_UNAVAILABLE' when state = 'CACHED' then 'CACHE_REUSED' when coalesce(hits, 0) = 0 then 'SEARCH_EXECUTED_ZERO_HITS' else 'SEARCH_EXECUTED' end evidence_status, coalesce(hits, 0) hits
from members m join s using (sha) left join h using (sha)""")
def ev12(spark, sf):
    m = load(spark, sf, "members")
    hits = m.where("n_chars % 4 > 0").select("sha", F.lit("phrogs").alias("adapter"), (F.col("n_chars") % 5).alias("f")).distinct()
    state = F.when(F.min("host_genus") == "de", "UNAVAILABLE").when(F.min("host_genus") == "fr", "CACHED").otherwise("EXECUTED")
    searches = m.groupBy("sha").agg(state.alias("state")).withColumn("adapter", F.lit("phrogs"))
    return ev.fan_out(m.select(F.col("member_id").alias("model_id"), "sha"), searches, hits)


@query("ev13_support_matrix", "hits proteins", f"""
with {CH} select p.protein_id, max(coalesce((source = 'Pfam' and supports)::int, 0)) pfam, max(coalesce((source = 'VOGDB' and supports)::int, 0)) vogdb, max(coalesce((source = 'PHROGs' and supports)::int, 0)) phrogs, max(coalesce((source = 'Swiss-Prot' and supports)::int, 0)) swissprot
from proteins p left join ch using (protein_id) group by 1""")
def ev13(spark, sf):
    return ev.support_matrix(load(spark, sf, "proteins"), classified_hits(spark, sf))


EXTERNAL = "select genome_id, concat('X', model_id) external_id, s, e, strand, case when e % 5 = 0 then 'MVL' else concat('M', cast((e - s) % 97 as varchar(9)), '*') end translation, case when s % 3 = 0 then 'hypothetical protein' else 'portal protein' end product from {models} where provider = 'prodigal_gv'"


@query("ev14_external_import", "sparse_models", f"""
with x as ({EXTERNAL.format(models='sparse_models')}), m as (select genome_id, s, e, strand, count(*) n, min(model_id) model_id, 'M' || (e - s) % 97 protein from sparse_models where provider = 'phanotate' group by all)
select x.genome_id, external_id, case when n = 1 and rtrim(translation, '*') = protein then model_id end model_id, product,
 case when n = 1 and rtrim(translation, '*') = protein then case when product = 'hypothetical protein' then 'SKIPPED_UNKNOWN_PRODUCT' else 'ACCEPTED' end else 'NO_UNIQUE_EXACT_MATCH' end outcome from x left join m using (genome_id, s, e, strand)""")
def ev14(spark, sf):
    m = load(spark, sf, "sparse_models")
    own = m.where("provider = 'phanotate'").withColumn("protein", F.expr("concat('M', cast((e - s) % 97 as string))"))
    return ev.external_import(own, spark.sql(EXTERNAL, models=m))


GROUPS = "select protein_id query, case source when 'Pfam' then 'other' when 'VOGDB' then 'phage' when 'PHROGs' then 'bacteria' else 'eukaryote' end source_group, case when bits >= 100 then 'foldseek' else 'blastp' end method, identity - 0.1 sequence_identity from {hits}"


@query("ev15_cross_group_review", "hits", f"""
with g as ({GROUPS.format(hits='hits')}) select query, count(*) hit_count, string_agg(distinct source_group, ';' order by source_group) source_groups, string_agg(distinct method, ';' order by method) methods,
 case when count(distinct source_group) filter (where source_group <> 'other') >= 2 and bool_or(sequence_identity < 0.25) then 'manual_review' else 'background' end review_priority from g group by 1""")
def ev15(spark, sf):
    return ev.cross_group_review(spark.sql(GROUPS, hits=load(spark, sf, "hits")))


TOPS = {"PHROGs": "phrogs", "VOGDB": "vogdb", "Swiss-Prot": "swissprot"}
top_sql = ", ".join(f"arg_min(struct_pack(l := identifier || ' - ' || description, e := evalue, c := query_coverage, i := identity), (evalue, hit_id)) filter (where source = '{s}') {n}" for s, n in TOPS.items())


@query("ev16_top_hits", "hits", f"""
with t as (select protein_id, {top_sql} from hits group by 1) select protein_id, {', '.join(f"{n}.l {n}_hit, {n}.e {n}_evalue, round({n}.c, 6) {n}_coverage, round({n}.i, 6) {n}_identity" for n in TOPS.values())} from t""")
def ev16(spark, sf):
    t = ev.top_hits(load(spark, sf, "hits"), TOPS)
    return t.select("protein_id", *[F.round(c, 6).alias(c) if c.endswith(("coverage", "identity")) else F.col(c) for c in t.columns[1:]])


@query("ev17_deduplicate_fragments", "hits", """
with f as (select protein_id, lower(source) src, identifier, description from hits union all select protein_id, lower(source), identifier, description from hits where bits >= 100), d as (select distinct * from f)
select case src when 'swiss-prot' then 'Swiss-Prot' when 'phrogs' then 'PHROGs' when 'vogdb' then 'VOGDB' else 'Pfam' end source, count(*) records from d group by 1""")
def ev17(spark, sf):
    h = load(spark, sf, "hits")
    part = lambda d: d.select("protein_id", F.lower("source").alias("src"), "identifier", "description")
    d = ev.deduplicate(part(h), part(h.where("bits >= 100")))
    return d.groupBy(ev.canonical_source(F.col("src")).alias("source")).agg(F.count("*").alias("records"))


@query("ev18_search_outcome", "hits", f"""
with {CH}, s as (select * from (values ('Pfam', 'AVAILABLE'), ('VOGDB', 'AVAILABLE'), ('PHROGs', 'RESOURCE_MISSING'), ('InterPro', 'AVAILABLE')) t(source, state)),
a as (select source, count(*) n, count(distinct protein_id) p from ch where supports group by 1)
select source, case when state <> 'AVAILABLE' then 'UNAVAILABLE' when coalesce(n, 0) > 0 then 'SUCCESS_WITH_HITS' else 'SUCCESS_NO_HIT' end outcome, case when state = 'AVAILABLE' then coalesce(n, 0) end accepted_hits, case when state = 'AVAILABLE' then coalesce(p, 0) end proteins from s left join a using (source)""")
def ev18(spark, sf):
    status = spark.createDataFrame([("Pfam", "AVAILABLE"), ("VOGDB", "AVAILABLE"), ("PHROGs", "RESOURCE_MISSING"), ("InterPro", "AVAILABLE")], "source string, state string")
    return ev.outcome_summary(status, classified_hits(spark, sf))
