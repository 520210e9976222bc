import random

from virocohort.operators import screens

HSP = "hsp_id string, genome_id string, reference_id string, qs bigint, qe bigint, ss bigint, se bigint, qseq string, sseq string"
GENE = "reference_id string, gene string, rs bigint, re bigint, rstrand int"
CDS = "genome_id string, model_id string, s bigint, e bigint, strand string"


def alignment(rng, i):
    q = "".join(rng.choice("ACGT-") if rng.random() < 0.3 else "A" for _ in range(rng.randint(1, 60)))
    t = "".join(rng.choice("ACGT-") if rng.random() < 0.3 else "C" for _ in range(len(q) + rng.randint(0, 2)))
    qs, ss = rng.randint(1, 50), rng.randint(1, 50)
    qn, tn = sum(c != "-" for c in q), sum(c != "-" for c in t)
    qe, se = qs + max(qn, 1) - 1, ss + max(tn, 1) - 1
    if rng.random() < 0.5:
        ss, se = se, ss
    if rng.random() < 0.2:
        qs, qe = qe, qs
    return f"h{i}", f"G{i % 3}", f"R{i % 2}", qs, qe, ss, se, q, t


def mapped(row):
    """subject position -> query position, column by column"""
    _, _, _, qs, qe, ss, se, q, t = row
    x, s, out = qs, ss, {}
    for a, b in zip(q, t):
        if a != "-" and b != "-":
            out[s] = x
        x += (a != "-") * (1 if qe >= qs else -1)
        s += (b != "-") * (1 if se >= ss else -1)
    return out


def test_blocks_equal_the_columns(spark):
    rng = random.Random(8)
    rows = [alignment(rng, i) for i in range(80)] + [("e", "G0", "R0", 1, 1, 1, 1, "", ""), ("n", "G0", "R0", 1, 1, 1, 1, None, "A"), ("g", "G0", "R0", 1, 1, 1, 1, "-", "A")]
    blocks = screens.aligned_blocks(spark.createDataFrame(rows, HSP)).collect()
    got = {}
    for b in blocks:
        for k in range(b.s_hi - b.s_lo + 1):
            assert (b.hsp_id, b.s_lo + k) not in got
            got[b.hsp_id, b.s_lo + k] = b.q_lo + b.q_step * k
    assert got == {(r[0], s): x for r in rows if r[7] is not None for s, x in mapped(r).items()}
    assert len(blocks) < len(got)


def test_projection_equals_the_columns(spark):
    rng = random.Random(9)
    rows = [alignment(rng, i) for i in range(30)]
    genes = [(f"R{i % 2}", f"g{i}", s := rng.randint(1, 60), s + rng.randint(0, 8), rng.choice([1, -1])) for i in range(40)]
    cds = [(f"G{i % 3}", f"m{i}", s := rng.randint(1, 80), s + rng.randint(0, 8), rng.choice("+-")) for i in range(60)]
    got = screens.project_reference_cds(screens.aligned_blocks(spark.createDataFrame(rows, HSP)), spark.createDataFrame(genes, GENE), spark.createDataFrame(cds, CDS))
    want = set()
    for g, r in {(row[1], row[2]) for row in rows if mapped(row)}:
        for ref, gene, rs, re, strand in (x for x in genes if x[0] == r):
            shots = set()
            for row in rows:
                m = mapped(row)
                if row[1:3] == (g, r) and all(p in m for p in range(rs, re + 1)):
                    turn = (1 if row[4] >= row[3] else -1) * (1 if row[6] >= row[5] else -1)
                    shots.add((min(m[rs], m[re]), max(m[rs], m[re]), strand * turn))
            status = "UNMAPPABLE_REFERENCE_CDS" if not shots else "AMBIGUOUS_REFERENCE_MAPPING"
            if len(shots) == 1:
                a, b, d = next(iter(shots))
                hits = [c for c in cds if c[0] == g and c[4] == ("+" if d == 1 else "-") and c[2] <= b and c[3] >= a]
                exact = any(c[2:4] == (a, b) for c in hits)
                status = ("INDEL_REQUIRES_REVIEW" if b - a != re - rs else "EXACT_BOUNDARY_SUPPORT" if exact else "BOUNDARY_DISAGREEMENT" if hits
                          else "POSSIBLE_MISSED_CDS")
            want.add((g, r, gene, status))
    assert {(x.genome_id, x.reference_id, x.gene, x.status) for x in got.collect()} == want and len({w[3] for w in want}) > 3


def test_long_alignment_is_few_rows(spark):
    n = 5_000_000
    q = "A" * n
    t = "C" * 2_000_000 + "-" * 10 + "C" * (n - 2_000_010)
    blocks = screens.aligned_blocks(spark.createDataFrame([("h", "G", "R", 1, n, n - 10, 1, q, t)], HSP)).orderBy("s_lo").collect()
    assert [(b.s_lo, b.s_hi, b.q_lo, b.q_step) for b in blocks] == [(1, n - 2_000_010, n, -1), (n - 2_000_009, n - 10, 2_000_000, -1)]
