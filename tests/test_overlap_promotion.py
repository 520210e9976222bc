import random

from virocohort.operators import matching, orf

ROWS = ("genome_id string, cand_id string, strand string, s bigint, e bigint, stop bigint, score double, rbs_score double, outer_genes bigint, "
        "spanin_context boolean, policy_priority int, overlap_prefilter string")
FAMILY = "cand_id string, source string, identifier string"


def case(seed, n=260):
    rng = random.Random(seed)
    rows, families, outer, rz1 = [], [], [], []
    for i in range(n):
        strand, s = rng.choice("++-"), rng.randint(1, 2500)
        e = s + 3 * rng.randint(20, 90) - 1
        gate = rng.choice(["RBS_OR_SPANIN", "RBS_OR_SPANIN", "FAMILY_EVIDENCE_EXCEPTION", "NO_INITIATION_OR_FAMILY_SUPPORT"])
        rows.append((f"G{rng.randint(0, 1)}", f"c{i:03}", strand, s, e, e if strand == "+" else s, float(rng.randint(0, 12)), float(rng.choice([0, 8, 9])),
                     rng.randint(1, 2), rng.random() < 0.5, rng.randint(0, 1), gate))
        families += [(f"c{i:03}", "phrogs", f"phrog_{rng.randint(0, 5)}") for _ in range(rng.randint(0, 3))]
        outer += [(f"c{i:03}", "phrogs", f"phrog_{rng.randint(0, 5)}")]
        rz1 += [(f"c{i:03}",)] * (rng.random() < 0.4)
    used = {(r[0], r[2], r[5]) for r in rng.sample(rows, 10)}
    rna = [("G0", 700, 780), ("G1", 1500, 1510)]
    return rows, families, outer, rz1, used, rna


def walked(rows, families, outer, rz1, used, rna):
    """The rule as one walk over the candidates in order, the promoted ones kept as genes."""
    out, used, rz1 = [], set(used), {r[0] for r in rz1}
    of = lambda table, cand: {(s, i) for c, s, i in table if c == cand}
    for g, cand, strand, s, e, stop, score, rbs, genes, spanin, policy, gate in sorted(rows, key=lambda r: (r[10], -r[6], r[1])):
        if gate.startswith("NO_") or e - s + 1 < 75 or (g, strand, stop) in used or any(h == g and a <= e and b >= s for h, a, b in rna):
            continue
        met = [o for o in out if o[0] == g and o[4] <= e and o[5] >= s]
        gap = [s - o[4] if o[1] == "+" else o[5] - e for o in met]
        if any(o[1] != strand or d <= 0 or d % 3 == 0 for o, d in zip(met, gap)):
            continue
        fresh = of(families, cand) - of(outer, cand) - {f for o in met for f in of(families, o[3])}
        if genes + len(met) == 1 and spanin and rbs >= 8 and cand in rz1:
            code = "SHORT_ORF_RZ1_OVERLAP_PROMOTED"
        elif fresh:
            code = "SHORT_ORF_DISTINCT_FAMILY_OVERLAP_PROMOTED"
        else:
            continue
        out.append((g, strand, stop, cand, s, e, code))
        used.add((g, strand, stop))
    return sorted(out)


def promoted(spark, rows, families, outer, rz1, used, rna):
    frame = lambda data, schema: spark.createDataFrame(list(data), schema)
    got = orf.promote_overlaps(frame(rows, ROWS), frame(families, FAMILY), frame(outer, FAMILY), frame(rz1, "cand_id string"),
                               frame(used, "genome_id string, strand string, stop bigint"), frame(rna, "genome_id string, s bigint, e bigint"))
    return sorted(tuple(r) for r in got.select("genome_id", "strand", "stop", "cand_id", "s", "e", "code").collect())


def test_promotion_equals_the_walk(spark):
    for seed in (1, 3):
        data = case(seed)
        want = walked(*data)
        assert len({r[6] for r in want}) == 2 and len(want) > 10
        assert promoted(spark, *data) == want


def test_promoted_orf_is_a_gene_to_later_ones(spark):
    orfs = [("G0", "c1", "+", 100, 249, 249, 9.0, 9.0, 1, False, 0, "RBS_OR_SPANIN"), ("G0", "c2", "+", 101, 250, 250, 5.0, 9.0, 1, False, 0, "RBS_OR_SPANIN"),
            ("G0", "c3", "+", 103, 252, 252, 4.0, 9.0, 1, False, 0, "RBS_OR_SPANIN")]
    same = [("c1", "phrogs", "a"), ("c2", "phrogs", "a"), ("c3", "phrogs", "b")]
    # c2 brings nothing that c1 lacks, c3 is in the frame of c1; alone, each would be promoted
    assert [r[3] for r in promoted(spark, orfs, same, [], [], [], [])] == ["c1"]
    assert [r[3] for r in promoted(spark, orfs[1:], same, [], [], [], [])] == ["c2", "c3"]
    assert promoted(spark, orfs, same, [], [], [], [("G0", 200, 210)]) == []
    assert promoted(spark, [], [], [], [], [], []) == []


def test_chain_of_threats(spark):
    options = spark.createDataFrame([(f"{i:02}", "x") for i in range(8)], "item string, opt string")
    threats = spark.createDataFrame([(f"{i:02}", "x", f"{i - 1:02}") for i in range(1, 8)], "item string, opt string, earlier string")
    assert sorted(r[0] for r in matching.surviving_choice(options, threats).collect()) == ["00", "02", "04", "06"]
