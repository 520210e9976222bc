"""Incremental cohort ingest (ST01, ST04, ST05)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from virocohort.functions.sequence import normalise
from virocohort.operators.ordering import ordinal, running_total
from virocohort.session import cut_lineage, release
from virocohort.sources.scans import FASTA_FILES, parse_fasta


SAMPLES = ("sample_id string, name string, sha string, file_path string, state string, reused_from string, records bigint, bases bigint, "
           "batch int")
NUMBERED = r"^(.+)_([1-9][0-9]{0,8})$"


def sample_name(file_path: Column) -> Column:
    """The stem of a file's address with anything but letters, digits, ``_``, ``.`` and ``-`` as ``_``; ``sample`` if nothing is left."""
    stem = F.url_decode(F.regexp_replace(F.regexp_extract(file_path, r"([^/]+)\.[^.]+$", 1), r"\+", "%2B"))
    clean = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_.-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.when(clean == "", "sample").otherwise(clean)


def sample_files(records: DataFrame) -> DataFrame:
    """One row per landed file: name, checksum of its content, records, bases and whether any record is usable.

    The checksum adds up the digests of the records, so a file of many records is combined before the shuffle, and the
    order of its records does not matter.  Records: file_path, record_id, description, seq, reject_reason.
    """
    digest = F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("record_id", "description", "seq")]), 256)
    parts = [F.sum(F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"d{i}") for i in range(8)]
    files = records.withColumn("d", digest).groupBy("file_path").agg(
        *parts, F.count("*").alias("records"), F.sum(F.length(F.coalesce("seq", F.lit("")))).alias("bases"),
        F.bool_or(F.col("reject_reason").isNull()).alias("usable"))
    sha = F.sha2(F.concat_ws(",", "records", *[f"d{i}" for i in range(8)]), 256)
    return files.select("file_path", sample_name(F.col("file_path")).alias("name"), sha.alias("sha"), "records", "bases", "usable")


def place_samples(landed: DataFrame, registry: DataFrame) -> DataFrame:
    """ST01: name, sha, sample_id, state and reused_from of landed samples (name, sha, usable).

    ``registry`` has earlier samples (sample_id, name, sha).  The samples of a name are placed in order of checksum behind
    the earlier ones; the first takes the name, later ones a number that no other sample has as its name.  Checksums are
    lower-case hexadecimal.  No name's samples are ordered in one task, however many they are.
    """
    known = registry.groupBy("sha").agg(F.min("sample_id").alias("reused_from"))
    first = landed.groupBy("name", "sha").agg(F.bool_and("usable").alias("usable"))
    taken = registry.select(F.explode(F.array_distinct(F.array("name", "sample_id"))).alias("name")).groupBy("name").agg(F.count("*").alias("taken"))
    placed = ordinal(first.withColumn("axis", F.conv(F.substring("sha", 1, 6), 16, 10).cast("bigint")), ["name"], "axis", ["axis", "sha"], "k", 4096)
    placed = placed.join(taken, "name", "left").withColumn("at", F.col("k") + 1 + F.coalesce("taken", F.lit(0)))

    # numbers that other names hold: the j-th of them, r, moves every place from r - j on by one
    names = first.select("name").distinct()
    new = names.select(F.col("name").alias("sample_id")).join(registry, "sample_id", "left_anti").select("sample_id", F.col("sample_id").alias("name"))
    held = registry.select("sample_id", "name").unionByName(new).select(
        F.regexp_extract("sample_id", NUMBERED, 1).alias("base"), F.regexp_extract("sample_id", NUMBERED, 2).try_cast("bigint").alias("r"), "name")
    held = held.where("r >= 2 and not (base <=> name)").select(F.col("base").alias("name"), "r").distinct().join(names, "name", "left_semi")
    moves = ordinal(held, ["name"], "r", ["r"], "j").select("name", (F.col("r") - F.col("j")).alias("at"))
    events = placed.select("name", "at", "sha", "usable", F.lit(True).alias("sample")).unionByName(
        moves.withColumn("sample", F.lit(False)), allowMissingColumns=True)
    out = running_total(events, ["name"], "at", ["at", "sample", "sha"], F.when(F.col("sample"), 0).otherwise(1), "moved").where("sample")
    number = (F.col("at") + F.col("moved")).cast("string")
    state = F.when(F.col("reused_from").isNotNull(), "REUSED").when(~F.col("usable"), "FAILED").otherwise("SUCCESS")
    return out.join(known, "sha", "left").select(
        "name", "sha", F.when(F.col("at") > 1, F.concat_ws("_", "name", number)).otherwise(F.col("name")).alias("sample_id"), state.alias("state"), "reused_from")


def plan_samples(landed: DataFrame, registry: DataFrame) -> DataFrame:
    """ST01: what to do with landed samples (sample_id, sha, usable) given earlier ones (sample_id, sha).

    Known content is reused, unusable content fails alone, and a repeated name gets the suffix of its
    place among equal names, in order of checksum.
    """
    placed = place_samples(landed.withColumnRenamed("sample_id", "name"), registry.select("sample_id", F.col("sample_id").alias("name"), "sha"))
    return placed.select("sample_id", "sha", "state", "reused_from")


def sample_registry(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The samples of all micro-batches, or of those before a number; empty if there are none yet."""
    folder = f"{store}/samples"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SAMPLES)
    table = spark.read.schema(SAMPLES).parquet(folder)
    return table if before is None else table.where(F.col("batch") < before)


def land_batch(batch: DataFrame, number: int, store: str, annotate: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """ST01: settle one micro-batch of parsed records against the samples of earlier ones.

    Tables, one folder a batch: ``samples`` (see SAMPLES), ``contigs`` of samples that succeed, ``quarantine`` of rejected
    records, ``annotated``.  Only earlier batches are looked at, so a batch repeated after a failure replaces itself by the
    same rows.  The files are parsed once; equal files of one name are one sample; failed content may come again.
    """
    spark = batch.sparkSession
    at = lambda table: f"{store}/{table}/batch={number}"
    records = cut_lineage(batch)
    files = cut_lineage(sample_files(records))
    registry = sample_registry(spark, store, number)
    earlier = registry.select("sample_id", "name", F.when(F.col("state") == "SUCCESS", F.col("sha")).alias("sha"))
    one = files.groupBy("name", "sha").agg(F.min("file_path").alias("file_path"), F.first("records").alias("records"), F.first("bases").alias("bases"))
    columns = [c for c in registry.columns if c != "batch"]
    place_samples(files, earlier).join(one, ["name", "sha"]).select(*columns).write.mode("overwrite").parquet(at("samples"))
    fresh = sample_registry(spark, store).where(F.col("batch") == number).where("state = 'SUCCESS'").select("file_path", "sample_id")
    records.where("reject_reason is null").join(fresh, "file_path").withColumn("sha", F.sha2("seq", 256)).write.mode("overwrite").parquet(at("contigs"))
    records.where("reject_reason is not null").withColumn("sample_id", sample_name(F.col("file_path"))).write.mode("overwrite").parquet(at("quarantine"))
    if annotate is not None:
        annotate(spark.read.parquet(at("contigs"))).write.mode("overwrite").parquet(at("annotated"))
    release(records)
    release(files)


def ingest_stream(spark: SparkSession, landing: str, store: str, checkpoint: str, annotate: Callable[[DataFrame], DataFrame] | None = None):
    """ST01: every new FASTA file once, settled by ``land_batch``.

    The file source remembers what it has read in ``checkpoint``; what became of each sample is kept in the tables of
    ``store``.  A file without a byte gives no record and so no sample.
    """
    lines = (spark.readStream.format("text").option("lineSep", "\n>").option("pathGlobFilter", FASTA_FILES).option("recursiveFileLookup", "true")
             .load(landing).select("value", F.col("_metadata.file_path").alias("file_path")))
    records = parse_fasta(lines).withColumn("seq", normalise(F.col("seq")))
    return records.writeStream.foreachBatch(lambda batch, number: land_batch(batch, number, store, annotate)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_summary(samples: DataFrame) -> DataFrame:
    """ST04: samples per state and stage."""
    return samples.groupBy("stage").pivot("state", ["SUCCESS", "REUSED", "FAILED"]).count().fillna(0)


def state_stream(events: DataFrame) -> DataFrame:
    """ST04: the same counts kept up to date over a stream (use output mode ``update``)."""
    return events.groupBy("stage", "state").agg(F.count("*").alias("samples"))


def segment_rollup(models: DataFrame) -> DataFrame:
    """ST05: genes per segment, and genome totals that count a shared protein sequence once.

    Segments are never concatenated; sha identifies the protein sequence.
    """
    per = models.groupBy("genome_id", "segment_id").agg(F.count("*").alias("models"), F.max("e").alias("last_base"))
    whole = models.groupBy("genome_id").agg(F.count_distinct("segment_id").alias("segments"), F.count_distinct("sha").alias("unique_proteins"), F.count("*").alias("genome_models"))
    return per.join(whole, "genome_id")
