"""Report and export tables (SK01-SK11): text lines and long tables ready for a writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from virocohort.functions.columns import joined
from virocohort.rules import genetics as g

STATES = ("KNOWN_FUNCTION", "PROBABLE_FUNCTION", "FUNCTIONAL_CLASS_ONLY", "CONSERVED_UNKNOWN", "CONFLICTING_EVIDENCE", "UNRESOLVED")


def flat_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SK01: fixed columns in order, arrays joined by ``;``, nulls empty."""
    kinds = dict(df.dtypes)
    text = lambda c: F.array_join(c, ";") if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(*[text(c).alias(c) for c in columns])


def write_table(df: DataFrame, columns: Sequence[str], path: str, partition: str = "genome_id") -> None:
    """SK01: one folder per genome; rows of a genome are gathered first so that each folder has few files."""
    out = flat_table(df, [*columns, *([partition] if partition not in columns else [])])
    out.repartition(partition).write.mode("overwrite").partitionBy(partition).option("sep", "\t").option("header", "true").csv(path)


def fasta_lines(df: DataFrame, name: Column, seq: str, width: int | None = None) -> DataFrame:
    """SK02: FASTA text of each record, wrapped when a width is given."""
    body = F.regexp_replace(seq, "(.{%d})(?=.)" % width, "$1\n") if width else F.col(seq)
    return df.select(F.concat(F.lit(">"), name, F.lit("\n"), body).alias("value"))


def gff_lines(models: DataFrame, source: str = "virocohort") -> DataFrame:
    """SK03: GFF3 lines; attributes are URL-encoded and the phase follows a partial 5' end.

    models: genome_id, model_id, s, e, strand, partial_5, partial_3, codon_start, product.
    """
    enc = lambda c: F.replace(F.url_encode(F.coalesce(c, F.lit(""))), F.lit("+"), F.lit("%20"))
    attrs = F.concat_ws(";", F.concat(F.lit("ID="), "model_id"), F.concat(F.lit("product="), enc(F.col("product"))), F.concat(F.lit("partial_5prime="), F.col("partial_5").cast("string")), F.concat(F.lit("partial_3prime="), F.col("partial_3").cast("string")))
    phase = F.when(F.col("partial_5"), F.col("codon_start") - 1).otherwise(0).cast("string")
    return models.select("genome_id", F.concat_ws("\t", "genome_id", F.lit(source), F.lit("CDS"), F.col("s").cast("string"), F.col("e").cast("string"), F.lit("."), "strand", phase, attrs).alias("value"))


def feature_table(models: DataFrame) -> DataFrame:
    """SK04: five-column feature table, several lines per gene, numbered within the gene."""
    plus = F.col("strand") == "+"
    a = F.concat(F.when(F.col("partial_5"), "<").otherwise(""), F.when(plus, F.col("s")).otherwise(F.col("e")).cast("string"))
    b = F.concat(F.when(F.col("partial_3"), ">").otherwise(""), F.when(plus, F.col("e")).otherwise(F.col("s")).cast("string"))
    safe = F.replace(F.regexp_replace(F.coalesce("product", F.lit("hypothetical protein")), r"[\t\r\n]", " "), F.lit('"'), F.lit("'"))
    q = lambda k, v: F.concat(F.lit(f"\t\t\t{k}\t"), v)
    lines = F.array_compact(F.array(
        F.concat_ws("\t", a, b, F.lit("gene")), q("locus_tag", F.col("model_id")), F.concat_ws("\t", a, b, F.lit("CDS")), q("protein_id", F.concat(F.lit("gnl|virocohort|"), "model_id")), q("locus_tag", F.col("model_id")),
        q("product", safe), q("transl_table", F.lit("11")), F.when(F.col("partial_5"), q("codon_start", F.col("codon_start").cast("string")))))
    return models.select("genome_id", "model_id", "s", "e", F.posexplode(lines).alias("line", "value"))


def orf_table(models: DataFrame) -> DataFrame:
    """SK05: one row per gene with the flags a reviewer needs (cds, protein, product, partial flags)."""
    start, stop = F.substring("cds", 1, 3), F.substring("cds", -3, 3)
    flags = joined(
        F.when(start.isin(*g.RARE_STARTS), "rare start codon - review"), F.when(F.col("partial_5") | ~start.isin(*g.STARTS), "unresolved_5prime"), F.when(F.col("partial_3") | ~stop.isin(*g.STOPS), "unresolved_3prime"),
        F.when(F.col("protein").contains("*"), "internal_stop_review_no_automatic_recoding"), F.when(F.lower("product") == "hypothetical protein", "no_supported_product"))
    return models.select(
        F.col("model_id").alias("locus_tag"), F.col("genome_id").alias("contig"), F.col("s").alias("start"), F.col("e").alias("end"), "strand", F.length("cds").alias("length_nt"), F.length("protein").alias("length_aa"),
        start.alias("start_codon"), stop.alias("stop_codon"), F.col("partial_5").alias("partial_5prime"), F.col("partial_3").alias("partial_3prime"), "product", flags.alias("review_flag"), F.col("cds").alias("nucleotide_sequence"), F.col("protein").alias("protein_sequence"))


def curation_workbook(genes: DataFrame, classified: DataFrame, context: DataFrame, reviews: DataFrame, guard: DataFrame, tops: DataFrame) -> DataFrame:
    """SK06: everything a curator reads about a gene in one row (keys genome_id and protein_id)."""
    first = reviews.groupBy("protein_id").agg(F.min_by(F.struct("priority", "review_type"), F.element_at(F.create_map(*[F.lit(x) for kv in {"HIGH": 0, "MEDIUM": 1, "LOW": 2}.items() for x in kv]), F.col("priority"))).alias("r"))
    out = genes.join(classified.drop("genome_id"), "protein_id", "left").join(context.drop("genome_id"), "protein_id", "left").join(first, "protein_id", "left").join(guard, "protein_id", "left").join(tops, "protein_id", "left")
    return out.select(*[c for c in out.columns if c not in ("r", "guard_decision")], F.col("r.priority").alias("review_priority"), F.col("r.review_type").alias("review_issue"), F.coalesce("guard_decision", F.lit("")).alias("guard_decision"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SK07: checksum of every file below a folder, by relative path, read as splits of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", path.rstrip("/") + "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """SK07: files that are missing, unexpected or changed."""
    r, f = recorded.select("file", F.col("sha256").alias("r")), found.select("file", F.col("sha256").alias("f"))
    state = F.when(F.col("f").isNull(), "MISSING").when(F.col("r").isNull(), "UNEXPECTED").when(F.col("r") != F.col("f"), "CHANGED")
    return r.join(f, "file", "full").select("file", state.alias("problem")).where("problem is not null")


def cohort_summary(classified: DataFrame) -> DataFrame:
    """SK08: proteins per genome and functional state as columns."""
    wide = classified.groupBy("genome_id").pivot("functional_state", list(STATES)).count().fillna(0)
    return wide


def state_distribution(classified: DataFrame) -> DataFrame:
    """SK09: figure table of state counts."""
    return classified.groupBy("functional_state").agg(F.count("*").alias("count"))


def recurrence_histogram(recurrence: DataFrame) -> DataFrame:
    """SK09: families by number of genomes."""
    return recurrence.groupBy("genome_count").agg(F.count("*").alias("families"))


def heat_rows(recurrence: DataFrame, copies: DataFrame, k: int = 80) -> DataFrame:
    """SK09: copies by genome of the first ``k`` recurrent families."""
    top = recurrence.where("genome_count > 1").orderBy("family_id").limit(k).select("family_id")
    return copies.join(top, "family_id", "left_semi")


def centred(neighbourhoods: DataFrame) -> DataFrame:
    """SK09: neighbourhood coordinates counted from the leftmost gene (occurrence, start, end)."""
    low = neighbourhoods.groupBy("occurrence").agg(F.min("start").alias("origin"))
    return neighbourhoods.join(low, "occurrence").select("occurrence", "protein_id", (F.col("start") - F.col("origin")).alias("x0"), (F.col("end") - F.col("origin")).alias("x1"))


def protein_record(proteins: DataFrame, genome_id: str, protein_id: str) -> DataFrame:
    """SK11: one record; the genome prunes partitions, the id row groups."""
    return proteins.where((F.col("genome_id") == genome_id) & (F.col("protein_id") == protein_id))
