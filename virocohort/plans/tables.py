"""Projections of the supplied tables into the cohort data model.

One SQL text serves both engines; ``contigs`` alone needs two because lambda syntax differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

SPREAD = ("lineitem", "orders", "documents", "events", "supplier")

MODEL_ID = ("concat('M', cast(l_orderkey as varchar(20)), '_', cast(l_linenumber as varchar(20)), '_', "
            "cast(l_partkey as varchar(20)), '_', cast(l_suppkey as varchar(20)), '_', "
            "cast(cast(l_quantity as int) as varchar(20)), '_', substr(cast(l_shipdate as varchar(30)), 1, 10))")
PLACE = "(l_partkey*97+l_linenumber*31+l_orderkey*13)"

# part type and size class -> a product description of the kind search databases return
DESCRIPTIONS = """(values
 ('ECONOMY',0,'major head protein'),('ECONOMY',1,'Major capsid protein'),('ECONOMY',2,'capsid'),('ECONOMY',3,'helix-turn-helix domain'),
 ('STANDARD',0,'tail fiber protein'),('STANDARD',1,'Minor tail protein'),('STANDARD',2,'tail protein'),('STANDARD',3,'transcriptional regulator'),
 ('MEDIUM',0,'terminase large subunit'),('MEDIUM',1,'terminase'),('MEDIUM',2,'DNA helicase'),('MEDIUM',3,'integrase'),
 ('PROMO',0,'hypothetical protein'),('PROMO',1,'DUF1234 family protein'),('PROMO',2,'gp12'),('PROMO',3,'conserved protein of unknown function'),
 ('LARGE',0,'sp|P12345|ENLYS_BPT4 endolysin {{ECO:0000255}}'),('LARGE',1,'endolysin gp144'),('LARGE',2,'putative Rz1 spanin'),('LARGE',3,'OPG44 kelch protein'),
 ('SMALL',0,'Interferon regulatory factor'),('SMALL',1,'BCS1 AAA ATPase'),('SMALL',2,'mitochondrial carrier'),('SMALL',3,'Excisionase and transcriptional regulator'))
 as d(d_type, d_class, d_description)"""

PROJECTIONS = {
    # 600 calls per genome within 20 kb: a dense overlap workload
    "gene_models": f"""
        select concat('G', cast(l_suppkey as varchar(20))) genome_id, {MODEL_ID} model_id,
               cast(1 + {PLACE} % 20000 as bigint) s,
               cast(1 + {PLACE} % 20000 + 89 + 3 * cast(l_quantity as int) as bigint) e,
               case when l_returnflag = 'R' then '-' else '+' end strand,
               case when l_linestatus = 'O' then 'phanotate' else 'prodigal_gv' end provider
        from {{lineitem}}""",
    # the same calls on a 400 kb axis snapped to a 120-base grid: loci of a few models each
    "sparse_models": f"""
        select concat('G', cast(l_suppkey as varchar(20))) genome_id, {MODEL_ID} model_id,
               cast(1 + 120 * ({PLACE} % 3333) as bigint) s,
               cast(1 + 120 * ({PLACE} % 3333) + 89 + 90 * (cast(l_quantity as int) % 4) as bigint) e,
               case when l_returnflag = 'R' then '-' else '+' end strand,
               case when l_linestatus = 'O' then 'phanotate' else 'prodigal_gv' end provider
        from {{lineitem}}""",
    "proteins": """
        select concat('P', cast(o_orderkey as varchar(20))) protein_id,
               concat('G', cast(o_custkey as varchar(20))) genome_id,
               cast(1 + (o_orderkey * 7919) % 40000 as bigint) s,
               cast(1 + (o_orderkey * 7919) % 40000 + 199 + 3 * (o_orderkey % 400) as bigint) e,
               case when o_orderstatus = 'F' then '-' else '+' end strand,
               o_orderpriority priority, cast(o_orderkey as bigint) n
        from {orders}""",
    "hits": f"""
        select concat('P', cast(l_orderkey as varchar(20))) protein_id, {MODEL_ID} hit_id,
               case l_linenumber % 4 when 0 then 'PHROGs' when 1 then 'VOGDB' when 2 then 'Swiss-Prot' else 'Pfam' end source,
               cast(concat('1e-', cast(cast(l_quantity as int) as varchar(10))) as double) evalue,
               0.3 + 7 * l_discount identity, 0.4 + 7 * l_tax query_coverage, 0.95 - 4 * l_discount subject_coverage,
               l_quantity * 4 bits, cast(20 + 2 * cast(l_quantity as int) as bigint) aln_len,
               d_description description, concat(lower(p_brand), '_', cast(p_size % 5 as varchar(10))) identifier,
               case when l_returnflag = 'R' then 'Escherichia phage T4' else 'Homo sapiens' end organism,
               l_linestatus = 'F' reviewed, concat('gene', cast(p_size % 3 as varchar(10))) gene,
               case when l_linenumber % 4 = 0 and l_returnflag = 'A' then 'integration and excision' when l_returnflag = 'N' then 'unknown' end category
        from {{lineitem}} join {{part}} on l_partkey = p_partkey
             join {DESCRIPTIONS} on p_type = d_type and p_size % 4 = d_class""",
    "classified": """
        select concat('P', cast(o_orderkey as varchar(20))) protein_id,
               concat('G', cast(o_custkey as varchar(20))) genome_id,
               cast(1 + (o_orderkey * 7919) % 40000 as bigint) s,
               cast(1 + (o_orderkey * 7919) % 40000 + 199 + 3 * (o_orderkey % 400) as bigint) e,
               case when o_orderstatus = 'F' then '-' else '+' end strand,
               case o_orderkey % 9 when 0 then 'major capsid protein' when 1 then 'tail fiber protein' when 2 then 'endolysin'
                    when 3 then 'dna helicase' when 4 then 'terminase large subunit' when 5 then 'integrase' else null end proposed_function,
               case when o_orderkey % 9 <= 5 then (case when o_orderpriority = '1-URGENT' then 'KNOWN_FUNCTION' else 'PROBABLE_FUNCTION' end)
                    when o_orderpriority in ('1-URGENT', '2-HIGH') then 'CONSERVED_UNKNOWN'
                    when o_orderpriority = '3-MEDIUM' then 'FUNCTIONAL_CLASS_ONLY'
                    when o_orderpriority = '5-LOW' then 'CONFLICTING_EVIDENCE' else 'UNRESOLVED' end functional_state,
               case when o_orderkey % 9 > 5 and o_orderpriority = '3-MEDIUM' then 'tail baseplate domain' else null end domain_summary,
               case when o_orderpriority = '1-URGENT' then 'HIGH' when o_orderpriority = '2-HIGH' then 'MODERATE' else 'LOW' end confidence,
               concat('PMF-', lpad(cast(1 + (o_orderkey * 31) % 997 as varchar(10)), 6, '0')) family_id
        from {orders}""",
    # alignment rows of one order read as the HSPs of one genome pair
    "hsps": """
        select cast(l_orderkey as bigint) pair_id, cast(1 + l_partkey % 300 as bigint) qs,
               cast(1 + l_partkey % 300 + cast(l_quantity as int) as bigint) qe,
               cast(cast(l_quantity as int) + 1 as bigint) aln_len,
               cast(floor((cast(l_quantity as int) + 1) * (0.9 - l_discount)) as bigint) nident, l_extendedprice score
        from {lineitem}""",
    # documents as proteins of a cohort: exact copies are true duplicates
    "members": """
        select concat('D', cast(doc_id as varchar(20))) member_id, source genome_id, lang host_genus,
               md5(text) sha, cast(n_chars as bigint) n_chars, cast(doc_id as bigint) n
        from {documents}""",
}

CONTIGS_SPARK = """
    select concat('G', s_suppkey) genome_id,
           array_join(transform(sequence(1, 64), i -> translate(md5(concat(cast(s_suppkey as string), '-', cast(i as string))),
                      '0123456789abcdef', 'ACGTACGTACGTACGT')), '') seq
    from {supplier}"""
CONTIGS_DUCK = """
    select 'G' || s_suppkey genome_id,
           array_to_string(list_transform(range(1, 65), lambda i: translate(md5(s_suppkey::varchar || '-' || i::varchar),
                           '0123456789abcdef', 'ACGTACGTACGTACGT')), '') seq
    from supplier"""

# calls placed on the contigs, the longer ones first clipped to the contig end
CALLS = f"""
    select concat('G', cast(l_suppkey as varchar(20))) genome_id, {MODEL_ID} model_id,
           cast(1 + {PLACE} % 1900 as bigint) s,
           cast(least(2048, 1 + {PLACE} % 1900 + 59 + 3 * cast(l_quantity as int)) as bigint) e,
           case when l_returnflag = 'R' then '-' else '+' end strand,
           case when l_linestatus = 'O' then 'phanotate' else 'prodigal_gv' end provider
    from {{lineitem}}"""
PROJECTIONS["calls"] = CALLS


def base(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A supplied table.  A scan with fewer splits than cores (one small file) is spread out first;
    a table of many splits is read as it is."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in SPREAD and df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A projection, or a supplied table, as a DataFrame."""
    if name in BASE:
        return base(spark, sf, name)
    text = CONTIGS_SPARK if name == "contigs" else PROJECTIONS[name]
    used = {t: base(spark, sf, t) for t in BASE if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck_with(uses: list[str], body: str) -> str:
    """Prefix checking SQL with the projections it reads."""
    parts = []
    for name in uses:
        text = CONTIGS_DUCK if name == "contigs" else PROJECTIONS[name].format(**{t: t for t in BASE})
        parts.append(f"{name} as ({text})")
    body = body.strip()
    if body[:5].lower() == "with ":
        parts.append(body[5:].strip())
        return "with recursive " + ",\n".join(parts) if body[5:14].lower() != "recursive" else (
            "with recursive " + ",\n".join(parts[:-1] + [body[14:].strip()]))
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
