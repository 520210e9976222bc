import random

from pyspark.sql import functions as F

from virocohort.functions import sequence as sq
from virocohort.operators import orf
from virocohort.rules import genetics as g

PLAIN = {a + b + c: g.RESIDUES[16 * i + 4 * j + k] for i, a in enumerate(g.BASES) for j, b in enumerate(g.BASES) for k, c in enumerate(g.BASES)}


def rc(s):
    return s.translate(str.maketrans(g.COMPLEMENT_FROM, g.COMPLEMENT_TO))[::-1]


def random_contigs(n=3, length=1500, seed=2):
    rng = random.Random(seed)
    return [(f"G{i}", "".join(rng.choice("ACGT") for _ in range(length + i))) for i in range(n)]


def test_translation_of_plain_and_ambiguous_codons(spark):
    rows = [("ATGGCCTAA", "MA", "MA"), ("GTGGCCTAAGCC", "VA*A", "MA*A"), ("ATGCTNRAYNNN", "MLBX", "MLBX"), ("ATGGC", "M", "M"), ("TARATG", "*M", "*M")]
    df = spark.createDataFrame(rows, "cds string, t string, s string")
    for r in df.select("*", sq.translate(F.col("cds")).alias("got"), sq.translate_strict(F.col("cds")).alias("strict")).collect():
        assert (r.got, r.strict) == (r.t, r.s)


def test_views_are_cut_at_the_ends(spark):
    seq = "ACGTTGCA"
    df = spark.createDataFrame([(seq, d, lo, hi) for d in "+-" for lo in range(-3, 9) for hi in range(lo, 12)], "seq string, strand string, lo int, hi int")
    for r in df.select("*", sq.StrandView(F.col("seq"), F.length("seq"), F.col("strand")).slice(F.col("lo"), F.col("hi")).alias("x")).collect():
        whole = seq if r.strand == "+" else rc(seq)
        assert r.x == whole[max(0, r.lo):max(0, r.hi)]


def test_starts_per_stop(spark):
    contigs = random_contigs()
    contigs[0] = (contigs[0][0], contigs[0][1][:700] + "N" + contigs[0][1][701:])
    got = {(r.genome_id, r.strand, r.left, r.right) for r in orf.stop_starts(spark.createDataFrame(contigs, "genome_id string, seq string"), 90).collect()}
    want = set()
    for name, seq in contigs:
        for strand in "+-":
            s = seq if strand == "+" else rc(seq)
            for right in range(3, len(s) + 1):
                if s[right - 3:right] not in g.STOPS:
                    continue
                for left in range(right - 6, -1, -3):
                    codon = s[left:left + 3]
                    if codon in g.STOPS or set(codon) - set("ACGT"):
                        break
                    if right - left >= 90 and codon in g.STARTS:
                        want.add((name, strand, left, right))
    assert got == want and want


def test_upstream_gap_with_long_genes(spark):
    rng = random.Random(9)
    genes = []
    for i in range(200):
        a = rng.randint(0, 20000)
        genes.append(("G", rng.choice("+-"), f"m{i}", a, a + (9000 if i % 50 == 0 else rng.randint(60, 900))))
    df = spark.createDataFrame(genes, "genome_id string, strand string, model_id string, left long, right long")
    got = {r.model_id: r.upstream_gap for r in orf.upstream_gap(df, df, size=500).collect()}
    for _, d, m, left, right in genes:
        before = [(a, b) for _, x, _, a, b in genes if x == d and a < left and b < right]
        assert got[m] == (left - max(before)[1] if before else None)


def test_short_orf_acceptance_is_greedy_by_strand_and_stop(spark):
    rows = [("G", "c1", "+", 1, 100, 100, 10.0, 100, True), ("G", "c2", "+", 50, 160, 160, 12.0, 111, True), ("G", "c3", "-", 97, 200, 500, 9.0, 104, True), ("G", "c4", "+", 300, 400, 400, 9.0, 20, True), ("G", "c5", "+", 600, 700, 700, 9.0, 101, False)]
    df = spark.createDataFrame(rows, "genome_id string, cand_id string, strand string, s long, e long, right long, score double, uncovered long, eligible boolean").withColumn("review_reason", F.lit("x"))
    got = {r.cand_id: r.accepted for r in orf.accept_short_orfs(df).collect()}
    # c2 overlaps accepted c1 by more than four bases, c3 by exactly four; c4 has too little free sequence
    assert got == {"c1": True, "c2": False, "c3": True, "c4": False, "c5": False}


def test_short_orf_audit_holds_at_each_turn(spark):
    """Against a walk over single bases, every candidate told after the ORFs accepted before it."""
    rng = random.Random(6)
    genes = [(f"G{rng.randint(0, 1)}", f"g{i}", s, s + rng.randint(100, 200), "+") for i in range(12) for s in [rng.randint(1, 3000)]]
    rows = [(f"G{rng.randint(0, 1)}", f"c{i:03d}", rng.choice("+-"), s, s + rng.randint(75, 250), rng.randint(1, 900), float(rng.randint(5, 20)), rng.random() < 0.7) for i in range(200) for s in [rng.randint(1, 3000)]]
    free = {r[1]: set(range(r[3], r[4] + 1)) - {x for g in genes if g[0] == r[0] for x in range(g[2], g[3] + 1)} for r in rows}
    blocks = lambda s, e, gs, ge: min(e, ge) - max(s, gs) + 1 > 4 or (min(e, ge) >= max(s, gs) and (s <= gs and e >= ge or gs <= s and ge >= e))
    gap = {r[1]: not any(g[0] == r[0] and blocks(r[3], r[4], g[2], g[3]) for g in genes) for r in rows}
    table = [(*r[:7], len(free[r[1]]), gap[r[1]], r[7] and gap[r[1]] and len(free[r[1]]) >= 30, "x") for r in rows]
    want, taken, stops = {}, [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[5], -r[6], r[3])):
        stops.setdefault((r[0], r[2], r[5]), []).append(r)
    for (genome, *_), members in sorted(stops.items(), key=lambda kv: kv[0][1:]):
        mine = [t for g, *t in taken if g == genome]
        told = {r[1]: (len(free[r[1]] - {x for s, e in mine for x in range(s, e + 1)}), gap[r[1]] and not any(blocks(r[3], r[4], s, e) for s, e in mine)) for r in members}
        best = next((r for r in members if r[7] and told[r[1]][1] and told[r[1]][0] >= 30), None)
        for r in members:
            want[r[1]] = (*told[r[1]], r is best)
        if best:
            taken.append((genome, best[3], best[4]))
    df = spark.createDataFrame(table, "genome_id string, cand_id string, strand string, s long, e long, right long, score double, uncovered long, gap_eligible boolean, eligible boolean, review_reason string")
    got = orf.accept_short_orfs(df, spark.createDataFrame(genes, "genome_id string, model_id string, s long, e long, strand string")).collect()
    assert {r.cand_id: (r.uncovered, r.gap_eligible, r.accepted) for r in got} == want
    assert all((r.review_reason == "SHORT_ORF_RESCUED_REVIEW") == r.accepted for r in got)


def test_repair_is_idempotent(spark):
    contigs = spark.createDataFrame(random_contigs(4, 900), "genome_id string, seq string")
    rng = random.Random(4)
    rows = [(f"G{rng.randint(0, 3)}", f"m{i}", s, s + 3 * rng.randint(20, 60) - 1, rng.choice("+-")) for i in range(120) for s in [rng.randint(1, 700)]]
    first = orf.repair_boundaries(spark.createDataFrame(rows, "genome_id string, model_id string, s long, e long, strand string").select("*", F.lit(False).alias("partial_5"), F.lit(False).alias("partial_3"), F.lit(1).alias("codon_start")), contigs)
    again = orf.repair_boundaries(first.select("genome_id", "model_id", F.col("new_s").alias("s"), F.col("new_e").alias("e"), "strand", "partial_5", "partial_3", "codon_start"), contigs)
    assert again.where("repaired").count() == 0 and first.where("repaired").count() > 0


def test_terminal_repeats(spark):
    body = random_contigs(1, 400)[0][1]
    dtr, itr = body + body[:33], body + rc(body[:27])
    df = spark.createDataFrame([("D", dtr), ("I", itr), ("N", body)], "genome_id string, seq string")
    assert {(r.genome_id, r.code, r.length_nt) for r in sq.terminal_repeats(df).collect()} == {("D", "DTR_CANDIDATE", 33), ("I", "ITR_CANDIDATE", 27)}


def test_start_enumeration_is_linear(spark):
    """One contig of half a million bases: a quadratic frame would take minutes."""
    import random
    import time

    from virocohort.operators import orf

    r = random.Random(0)
    contig = "".join(r.choice("ACGT") for _ in range(500_000))
    df = spark.createDataFrame([("G1", contig)], "genome_id string, seq string")
    began = time.time()
    found = orf.stop_starts(df, 300).count()
    assert found > 100 and time.time() - began < 60


def test_audit_query_of_a_record_without_replacements(spark, tmp_path):
    from virocohort.plans import catalogue

    spark.createDataFrame([(54240,), (1,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.genome_id: r.replaced_symbols for r in catalogue.QUERIES["sq01_normalise_audit"](spark, str(tmp_path)).collect()}
    assert got["G54240"] == ":0" and got["G1"] not in ("", ":0")


def test_codons_are_read_by_batches(spark):
    """Equal to codon by codon: ambiguity codes, lower case, short, empty, null and odd rows, stops within and at the end."""
    r = random.Random(4)
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for letters in ("ACGT", "ACGTacgtn", "ACGTRYSWKMBDHVN-", "TAG") for _ in range(60)]
    texts += [None, "", "A", "AT", "ATG", "TAA", "ATGTAA", "ATGTAATAA", "ATGéTAAC", "AT\nGTAACCC", "日本語ATG", "ATG TAA", " ATGTAA*"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    codons = F.filter(F.regexp_extract_all(F.upper("t"), F.lit("(.{3})")), lambda c: F.length(c) == 3)
    slow = F.array_join(F.transform(codons, sq.residue), "")
    rows = df.select("t", sq.residues(F.col("t")).alias("a"), slow.alias("b"), sq.translate(F.col("t")).alias("c"), F.regexp_replace(slow, r"\*$", "").alias("d")).collect()
    assert [(x.t, x.a, x.c) for x in rows] == [(x.t, x.b, x.d) for x in rows]
    plan = df.select(sq.translate(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan


def test_terminal_repeats_make_no_row_a_position(spark):
    """A repeat with copies between the ends; overlapping anchors; nothing is exploded by position or joined."""
    r = random.Random(9)
    body = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    end = body(30)
    rows = [("D", end + body(100) + end + body(50) + end), ("A", "A" * 100), ("N", body(200)), ("short", "ACGT"), ("none", None)]
    out = sq.terminal_repeats(spark.createDataFrame(rows, "genome_id string, seq string"))
    got = {(x.genome_id, x.code): (x.length_nt, x.internal_copies) for x in out.collect()}
    assert got[("D", "DTR_CANDIDATE")] == (30, "131") and got[("A", "DTR_CANDIDATE")] == (50, "") and {k[0] for k in got} == {"D", "A"}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
