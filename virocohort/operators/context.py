"""Gene order, neighbours, modules and hallmarks (WN01-WN06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virocohort.functions.labels import hallmark_matches, module_signal
from virocohort.operators.ordering import ordinal, running_total, with_neighbours
from virocohort.rules import fusion as rules

GENOME = ["genome_id"]
ORDER = ["s", "e", "protein_id"]


def gene_order(genes: DataFrame) -> DataFrame:
    """WN01: index along the genome, neighbours and intergenic distances."""
    rows = ordinal(genes, GENOME, "s", ORDER, "gene_order_index")

    def build(frame):
        w = frame.ordered
        return {
            "upstream_id": F.lag("protein_id").over(w), "downstream_id": F.lead("protein_id").over(w),
            "upstream_distance": F.col("s") - F.lag("e").over(w) - 1, "downstream_distance": F.lead("s").over(w) - F.col("e") - 1}

    return with_neighbours(rows, GENOME, "gene_order_index", 1, build)


def neighbours(genes: DataFrame, reach: int = 2) -> DataFrame:
    """WN02: ids of the genes within ``reach`` places, in order, without the gene itself."""
    rows = ordinal(genes, GENOME, "s", ORDER)

    def build(frame):
        return {"before": F.collect_list("protein_id").over(frame(-reach, -1)), "after": F.collect_list("protein_id").over(frame(1, reach))}

    rows = with_neighbours(rows, GENOME, "idx", reach, build)
    return rows.withColumn("neighbours", F.array_join(F.concat("before", "after"), ";")).drop("before", "after")


def signal_text() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("proposed_function", F.lit("")), F.coalesce("functional_category", F.lit(""))))


def module_members(genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """WN03: genes with order and signal, and the module segments they form.

    Two or more anchors of one module with no other signal between them make a segment.  Only
    signal-bearing genes take part, so segments of different modules cannot overlap (WN04).
    """
    rows = ordinal(genes.withColumn("signal", module_signal(signal_text())), GENOME, "s", ORDER)
    anchors = ordinal(rows.where("signal is not null").select("genome_id", "idx", "signal", "s", "e", "protein_id"), GENOME, "idx", ["idx"], "k", 4096)
    stepped = with_neighbours(anchors, GENOME, "k", 1, lambda f: {"previous": F.lag("signal").over(f.ordered)})
    change = F.when(F.col("previous").eqNullSafe(F.col("signal")), 0).otherwise(1)
    islands = running_total(stepped, GENOME, "idx", ["idx"], change, "island", 4096)
    first, last = F.min_by("s", "idx"), F.max_by("e", "idx")
    segments = islands.groupBy("genome_id", "island", F.col("signal").alias("functional_module")).agg(
        F.count("*").alias("anchors"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), first.alias("module_start"), last.alias("module_end")).where("anchors >= 2")
    segment_id = F.concat_ws("_", F.lit("module"), "functional_module", "module_start", "module_end")
    return rows, segments.withColumn("module_id", segment_id).drop("island")


def overlapping_segments(segments: DataFrame) -> DataFrame:
    """WN04: pairs of segments sharing a gene index; empty by construction, kept as an assertion."""
    from virocohort.operators.intervals import self_overlap
    cut = segments.select("genome_id", "module_id", (F.col("first_idx") + 1).alias("s"), (F.col("last_idx") + 1).alias("e"))
    return self_overlap(cut, GENOME, "module_id", size=64)


def module_context(genes: DataFrame, reach: int = 2) -> DataFrame:
    """WN03/WN05: module of each gene, and whether mixed signals surround a gene outside any module."""
    from virocohort.operators.intervals import overlap_join
    rows, segments = module_members(genes)
    spans = segments.select("genome_id", "module_id", "functional_module", (F.col("first_idx") + 1).alias("f"), (F.col("last_idx") + 1).alias("l"))
    slots = rows.select("genome_id", "protein_id", (F.col("idx") + 1).alias("i0"), (F.col("idx") + 1).alias("i1"))
    inside = overlap_join(slots, spans, GENOME, ("i0", "i1"), ("f", "l"), 64).select("genome_id", "protein_id", "module_id", "functional_module")
    rows = with_neighbours(rows, GENOME, "idx", reach, lambda f: {"near": F.collect_set("signal").over(f(-reach, reach))})
    out = rows.join(inside, ["genome_id", "protein_id"], "left")
    mixed = (F.size("near") > 1) & F.col("module_id").isNull()
    return out.select("genome_id", "protein_id", F.col("idx").alias("gene_order_index"), "signal", "module_id", "functional_module", mixed.alias("ambiguous_module_boundary"),
                      F.when(F.col("module_id").isNotNull(), "HIGH").when(mixed, "LOW").otherwise("NONE").alias("context_confidence"))


def hallmarks(classified: DataFrame, text_columns=("display_product", "proposed_function", "domain_summary", "functional_category")) -> DataFrame:
    """WN06: hallmark status per genome from annotation text; not established is not absence."""
    have = [c for c in text_columns if c in classified.columns]
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in have]))
    hits = classified.withColumn("hallmark", F.explode(hallmark_matches(text)))
    sure = F.col("functional_state").isin("KNOWN_FUNCTION", "PROBABLE_FUNCTION")
    order = F.when(F.col("confidence") == "HIGH", 1).when(F.col("confidence") == "MODERATE", 2).when(F.col("confidence") == "LOW", 3)
    agg = hits.groupBy("genome_id", "hallmark").agg(
        F.count_if(sure).alias("confident"), F.count("*").alias("matches"), F.min(F.when(sure, order)).alias("r1"), F.min(order).alias("r2"),
        F.min(F.when(sure, F.col("protein_id"))).alias("p1"), F.min("protein_id").alias("p2"))
    grid = classified.select("genome_id").distinct().select("genome_id", F.explode(F.array(*map(F.lit, rules.HALLMARKS))).alias("hallmark"))
    best = F.when(F.col("confident") > 0, F.col("r1")).otherwise(F.col("r2"))
    return grid.join(agg, ["genome_id", "hallmark"], "left").select(
        "genome_id", "hallmark",
        F.when(F.col("confident") > 0, "DETECTED").when(F.col("matches") > 0, "POSSIBLE_DOMAIN_OR_CATEGORY_SUPPORT").otherwise("NOT_ESTABLISHED").alias("status"),
        F.coalesce(F.when(F.col("confident") > 0, F.col("confident")).otherwise(F.col("matches")), F.lit(0)).alias("proteins"),
        F.coalesce(F.when(F.col("confident") > 0, F.col("p1")).otherwise(F.col("p2")), F.lit("")).alias("first_protein"),
        F.when(best == 1, "HIGH").when(best == 2, "MODERATE").when(best == 3, "LOW").otherwise("NONE").alias("highest_confidence"))
