"""URL filters as a sort-merge range join of reversed-host keys, in DataFrame operations only.

A rule (host, path) holds for its host and all hosts below it, where the path begins with the rule's.  Under
one reversed host a path prefix is an interval of byte keys, ``[prefix, prefix + FF)``, and intervals nest or are
apart.  A url therefore gets one key per level of its host (as many levels as any rule has), restricted to hosts
that have rules; keys and interval borders are sorted together and a running window keeps the rule that is
active, the innermost of the nest.  The stack of the sweep is held by level: a rule's parent is the last rule
that began one level up, and the rule's end gives the parent back.

A host that has most urls is dealt to as many blocks as its count asks for; its borders, few against its urls,
are repeated in each block.  Frames run from the start to the current row, so no group is held in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def reverse_labels(host):
    return F.reverse(F.split(host, r"\."))


def parsed(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds rest, host and path: the host after ``://`` up to / ? # in ASCII lower case, then the path up to ? #."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return (pages.withColumn("url", F.col(url_col).cast("string")).withColumn("rest", F.coalesce(rest, F.lit("")))
            .withColumn("raw_host", F.regexp_extract("rest", r"^[^/?#]*", 0))
            .withColumn("path", F.regexp_extract(F.expr("substring(rest, length(raw_host) + 1)"), r"^[^?#]*", 0))
            .withColumn("host", F.translate("raw_host", UPPER, LOWER)))


def clean_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with the key of their interval; of contrary verdicts block holds, rules with nulls never fit."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    return (rules.dropna(subset=["host", "path", "verdict"]).groupBy(host.alias("host"), "path")
            .agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise("allow").alias("verdict"))
            .select(F.array_join(reverse_labels("host"), ".").alias("site"), F.concat("host", "path").alias("rule"), "verdict",
                    F.length("host").alias("host_length"), F.encode("path", "utf-8").alias("low")))


def borders(rules: DataFrame) -> DataFrame:
    """Per site the sorted keys at which the active rule changes: a rule's start, and its end with its parent."""
    high = F.concat("low", F.unhex(F.lit("FF")))
    kept = F.struct("rule", "verdict", "host_length")
    steps = rules.select("site", F.col("low").alias("key"), F.lit(1).alias("step"), kept.alias("it"), high.alias("high")).unionByName(
        rules.select("site", high.alias("key"), F.lit(-1).alias("step"), F.lit(None).cast("struct<rule:string,verdict:string,host_length:int>").alias("it"), F.lit(None).cast("binary").alias("high")))
    run = Window.partitionBy("site").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    starts = steps.withColumn("level", F.sum("step").over(run)).where("step = 1").drop("step")
    # a rule seeks its parent one level up; there it sorts after every rule that began before it
    both = starts.select("site", "level", "key", "high", "it", F.lit(False).alias("seeks")).unionByName(
        starts.select("site", (F.col("level") - 1).alias("level"), "key", "high", "it", F.lit(True).alias("seeks")))
    up = Window.partitionBy("site", "level").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    parents = both.withColumn("parent", F.last(F.when(~F.col("seeks"), F.col("it")), True).over(up)).where("seeks")
    return parents.select("site", F.explode(F.array(
        F.struct(F.col("key").alias("key"), F.struct(F.col("it").alias("rule")).alias("active")),
        F.struct(F.col("high").alias("key"), F.struct(F.col("parent").alias("rule")).alias("active")))).alias("b")).select("site", "b.key", "b.active")


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", block_rows: int = 1_000_000) -> DataFrame:
    """One row per page: id, host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block).  The longest fitting rule (host and path together,
    then the longer host) decides, ``default`` where none fits.  A null url, or one without ``://``, has an empty host
    and path and fits no rule; an empty path begins with no rule's ``/``.  Repeated rows are judged each; without
    rules or pages the result is the defaults or empty.  Other columns are ignored.  ``block_rows`` is the most
    urls of a host that one block of the sweep holds, on average.
    """
    pages = parsed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("given")), "given")
    rules = clean_rules(rules)
    sites = rules.groupBy("site").agg(F.first(F.size(F.split("site", r"\."))).alias("levels"))
    levels = sites.agg(F.max("levels")).first()[0] or 0
    labels = reverse_labels("host")
    keys = (pages.where("url is not null").select("url", "host", "path").distinct()
            .select("url", "path", labels.alias("labels")).withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(levels, 1))))))
            .select("url", F.array_join(F.slice("labels", F.lit(1), F.col("level")), ".").alias("site"), F.encode("path", "utf-8").alias("key")))
    blocks = (keys.join(sites.select("site"), "site", "left_semi").groupBy("site").count()
              .select("site", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")))
    probes = keys.join(blocks, "site").select(
        "site", F.pmod(F.xxhash64("url"), "blocks").cast("int").alias("block"), "key", F.lit(1).alias("kind"), F.lit(None).cast("struct<rule:struct<rule:string,verdict:string,host_length:int>>").alias("active"), "url")
    edges = borders(rules).join(blocks, "site").select(
        "site", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", F.lit(0).alias("kind"), "active", F.lit(None).cast("string").alias("url"))
    sweep = Window.partitionBy("site", "block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    hits = (edges.unionByName(probes).withColumn("now", F.last("active", True).over(sweep))
            .where("kind = 1 and now.rule is not null").select(F.col("url").alias("hit_url"), "now.rule.*"))
    best = hits.groupBy("hit_url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_length")).alias("best"))
    return pages.join(best, F.col("url") == F.col("hit_url"), "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
