import math
import random

import pytest
from pyspark.sql import functions as F

from virocohort.operators import evaluation as mt
from virocohort.operators import families as fm
from virocohort.operators import reconcile as rc
from virocohort.operators import set_similarity
from virocohort.operators.evaluation import RELATION_ORDER


def relation_of(x, y):
    """The relation of two models by their ends alone."""
    ends = (x.s == y.s, x.e == y.e)
    if x.strand == y.strand and any(ends):
        kept_start = ends[0] if x.strand == "+" else ends[1]
        return "EXACT_MATCH" if all(ends) else "STOP_DIFFERENCE" if kept_start else "START_DIFFERENCE"
    if min(x.e, y.e) - max(x.s, y.s) < 1:
        return None
    return "STRAND_CONFLICT" if x.strand != y.strand else "START_AND_STOP_DIFFERENCE"


class Row:
    def __init__(self, g, m, s, e, d):
        self.genome_id, self.model_id, self.s, self.e, self.strand = g, m, s, e, d


def two_sets(n=150, seed=8):
    rng = random.Random(seed)
    make = lambda p: [(rng.choice(["HOT", "HOT", "A", "B"]), f"{p}{i:03d}", s, s + rng.choice([89, 119, 149]), rng.choice("+-")) for i in range(n) for s in [1 + 30 * rng.randint(0, 200)]]
    return make("p"), make("d")


def frame(spark, rows):
    return spark.createDataFrame(rows, "genome_id string, model_id string, s long, e long, strand string").repartition(5)


def test_greedy_pairs_follow_the_sequential_walk(spark):
    prim, sec = two_sets()
    got = {r.primary_id: r.secondary_id for r in rc.greedy_pairs(frame(spark, prim), frame(spark, sec)).collect() if r.primary_id}
    want = {}
    for g in {r[0] for r in prim}:
        used = set()
        right = [r for r in sec if r[0] == g]
        for _, m, s, e, _ in sorted((r for r in prim if r[0] == g), key=lambda r: (r[2], r[3], r[1])):
            ov = lambda r: max(0, min(e, r[3]) - max(s, r[2]) + 1)
            free = [r for r in right if r[1] not in used and ov(r) > 0]
            want[m] = None
            if free:
                best = max(free, key=lambda r: (ov(r) / (e - s + 1), -r[2], r[1]))
                if min(ov(best) / (e - s + 1), ov(best) / (best[3] - best[2] + 1)) >= 0.5:
                    used.add(best[1])
                    want[m] = best[1]
    assert got == want


def test_priority_relations_follow_the_rule(spark):
    a, b = two_sets(80, 11)
    got = sorted((r.a_id or "", r.b_id or "", r.relationship) for r in mt.compare_models(frame(spark, a), frame(spark, b)).collect())
    want = []
    for g in {r[0] for r in a} | {r[0] for r in b}:
        left = [Row(*r) for r in sorted((r for r in a if r[0] == g), key=lambda r: (r[2], r[3], r[1]))]
        right = [Row(*r) for r in sorted((r for r in b if r[0] == g), key=lambda r: (r[2], r[3], r[1]))]
        used, pending = set(), list(range(len(left)))
        for pr in RELATION_ORDER:
            for i in list(pending):
                c = [j for j in range(len(right)) if j not in used and relation_of(left[i], right[j]) == pr]
                if len(c) == 1:
                    used.add(c[0]); pending.remove(i); want.append((left[i].model_id, right[c[0]].model_id, pr))
                elif len(c) > 1 and pr in RELATION_ORDER[3:]:
                    pending.remove(i); want.append((left[i].model_id, "", "COMPLEX"))
        for i in pending:
            rest = any(j not in used and min(left[i].e, right[j].e) - max(left[i].s, right[j].s) + 1 > 1 for j in range(len(right)))
            want.append((left[i].model_id, "", "COMPLEX" if rest else "METHOD_A_ONLY"))
        want += [("", right[j].model_id, "METHOD_B_ONLY") for j in range(len(right)) if j not in used]
    assert got == sorted(want)


def test_greedy_one_to_one(spark):
    ref, pred = two_sets(120, 21)
    got = {(r.ref_id, r.pred_id) for r in mt.greedy_matches(frame(spark, ref), frame(spark, pred)).collect()}
    want = set()
    for g in {r[0] for r in ref}:
        edges = []
        for r in (x for x in ref if x[0] == g):
            for p in (x for x in pred if x[0] == g and x[4] == r[4]):
                ov = max(0, min(r[3], p[3]) - max(r[2], p[2]) + 1)
                stop = (r[3] == p[3]) if r[4] == "+" else (r[2] == p[2])
                s0, s1 = (r[2], p[2]) if r[4] == "+" else (r[3], p[3])
                share = ov / max(r[3] - r[2] + 1, p[3] - p[2] + 1)
                if ov and (stop or share >= 0.5):
                    edges.append((stop, s0 == s1, share, ov, -abs(s0 - s1), r[1], p[1]))
        a, b = set(), set()
        for *_, i, j in sorted(edges, reverse=True):
            if i not in a and j not in b:
                a.add(i); b.add(j); want.add((i, j))
    assert got == want


def test_stop_comparison(spark):
    pred = [("G", "p1", 10, 99, "+", "10..99"), ("G", "p2", 40, 99, "+", "40..99"), ("G", "p3", 300, 400, "-", "300..400"), ("G", "p4", 900, 999, "+", "x")]
    ref = [("G", "r1", 10, 99, "+", "10..99"), ("G", "r2", 300, 430, "-", "300..430"), ("G", "r3", 700, 800, "+", "700..800")]
    make = lambda rows: spark.createDataFrame(rows, "genome_id string, model_id string, s long, e long, strand string, parts string")
    got = {(r.ref_id, r.pred_id, r.outcome) for r in mt.stop_comparison(make(pred), make(ref)).collect()}
    assert got == {("r1", "p1", "exact"), ("r2", "p3", "stop_only"), ("r3", None, "missed"), (None, "p2", "unmatched_prediction"), (None, "p4", "unmatched_prediction")}


def test_similarity_families_join_near_copies_only(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    base = [word(400) for _ in range(5)]
    rows = []
    for f, text in enumerate(base):
        for k in range(12):
            at = rng.randint(0, 380)
            rows.append((f"f{f}_{k}", "G", text[:at] + word(8) + text[at + 8:]))
    df = spark.createDataFrame(rows, "member_id string, genome_id string, text string")
    got = {}
    for r in fm.similarity_families(df).collect():
        got.setdefault(r.component, set()).add(r.member_id.split("_")[0])
    assert len(got) == 5 and all(len(v) == 1 for v in got.values())


def brute_families(texts, share=0.3, coverage=0.5, width=8):
    sets = [{t[i:i + width] for i in range(max(1, len(t) - width + 1))} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= share * min(len(a), len(b)) and min(len(texts[i]), len(texts[j])) >= coverage * max(len(texts[i]), len(texts[j])):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def family_texts():
    """Families, chains that only some links hold together, a domain that most texts share, copies, short and repetitive texts."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYé") for _ in range(n))
    domain, out = word(60), ["", "AC", "AC", "ACDEFGH", "A" * 300, "A" * 160, "A" * 140 + word(20)]
    for k in range(50):
        text = word(rng.choice((40, 120, 300))) + (domain if k % 3 else "")
        for _ in range(3):
            out.append(text)
            at = rng.randint(0, len(text) // 2)
            text = text[at:] + word(rng.choice((5, 40, 90)))
    base = word(200)
    for _ in range(60):
        at = rng.randint(0, 150)
        out.append(base[:at] + word(12) + base[at + 12:])
    return out


@pytest.mark.parametrize(("crowd", "block"), [(2, 5), (64, 128)])
def test_similarity_families_equal_brute_force(spark, crowd, block):
    texts = family_texts()
    df = spark.createDataFrame([(f"m{i:04d}", t) for i, t in enumerate(texts)], "member_id string, text string").repartition(5)
    got = {r.member_id: r.component for r in fm.similarity_families(df, crowd=crowd, block=block, counters=1 << 12).collect()}
    want = brute_families(texts)
    least = {c: f"m{min(i for i, x in enumerate(want) if x == c):04d}" for c in set(want)}
    assert got == {f"m{i:04d}": least[c] for i, c in enumerate(want)}


def test_families_write_no_substrings(spark, monkeypatch):
    """Texts that share a third of themselves, and repetitive ones of their length: what is written grows with texts, not with their substrings."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    domain, written, whole = word(150), [], set_similarity.cut_lineage
    texts = [domain + word(300) for _ in range(60)] + [word(k) * (450 // k) for k in range(3, 9)]

    def kept(df):
        table = whole(df)
        written.append(table.count())
        return table

    monkeypatch.setattr(set_similarity, "cut_lineage", kept)
    df = spark.createDataFrame([(f"m{i:02d}", t) for i, t in enumerate(texts)], "member_id string, text string").coalesce(2)
    got = {r.component for r in fm.similarity_families(df, min_identity=0.5, crowd=8, counters=1 << 12).collect()}
    assert len(got) == len(set(brute_families(texts, 0.5))) == len(texts)
    assert max(written) <= 8 * len(texts) + 4 * set_similarity.SLICES, written


def test_families_over_blocks_equal_brute_force(spark, monkeypatch):
    """Blocks of some texts each, in one band of sizes and in several; repetitive texts have their own."""
    monkeypatch.setattr(set_similarity, "FEW", 1)
    texts = list(dict.fromkeys(family_texts()))
    nodes = spark.createDataFrame([(f"m{i:04d}", t) for i, t in enumerate(texts)], "node string, text string")
    got = {r.node: r.component for r in set_similarity.linked_components(nodes, 0.3, 0.5, letters=3000, counters=1 << 12)[0].collect()}
    want = brute_families(texts)
    least = {c: f"m{min(i for i, x in enumerate(want) if x == c):04d}" for c in set(want)}
    assert got == {f"m{i:04d}": least[c] for i, c in enumerate(want)}


def test_no_texts_no_families(spark):
    assert fm.similarity_families(spark.createDataFrame([], "member_id string, text string")).collect() == []


def test_a_longer_text_does_not_hide_a_link(spark):
    """S and S' belong together although a much longer text holds all of S."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    s = word(400)
    rows = [("s", s), ("t", s[:200] + word(5) + s[205:]), ("u", s + word(5000)), ("v", None)]
    got = {r.member_id: r.component for r in fm.similarity_families(spark.createDataFrame(rows, "member_id string, text string")).collect()}
    assert got == {"s": "s", "t": "s", "u": "u", "v": "v"}


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    d = spark.createDataFrame([(f"u{i}", i / 10) for i in range(9)], "unit string, diff double")
    a, b = mt.genome_bootstrap(d, 500).first(), mt.genome_bootstrap(d.repartition(3), 500).first()
    assert [round(x, 9) for x in a] == [round(x, 9) for x in b] and a.ci95_low < 0.4 < a.ci95_high


def test_exact_permutation_has_no_limit_of_units(spark):
    diffs = [((i * 37) % 19 - 8) / 100 for i in range(40)]
    got = mt.sign_flip_test(spark.createDataFrame([(f"u{i}", d) for i, d in enumerate(diffs)], "unit string, diff double")).first()
    counts = {0: 1}
    for d in diffs:
        step, new = round(d * 100), {}
        for v, n in counts.items():
            for x in (v + step, v - step):
                new[x] = new.get(x, 0) + n
        counts = new
    seen = round(sum(diffs) * 100)
    assert abs(got.p_value - sum(n for v, n in counts.items() if abs(v) >= abs(seen)) / 2**40) < 1e-9
    assert got.units == 40 and abs(got.estimate - sum(diffs) / 40) < 1e-9 and got.null_low < 0 < got.null_high


def test_permutation_of_200_units(spark):
    """More vectors than any integer type counts; the normal approximation is near by then."""
    rng = random.Random(15)
    diffs = [rng.randint(-9, 10) / 100 for _ in range(200)]
    got = mt.sign_flip_test(spark.createDataFrame([(f"u{i}", d) for i, d in enumerate(diffs)], "unit string, diff double"), scale=100).first()
    sd = math.sqrt(sum(d * d for d in diffs))
    assert abs(got.p_value - math.erfc((abs(sum(diffs)) - 0.01) / sd / math.sqrt(2))) < 0.01
    assert abs(got.null_high * 200 - 1.96 * sd) < 0.05 and abs(got.null_low + got.null_high) < 1e-4


def test_null_keys_and_places_are_kept(spark):
    from virocohort.operators.ordering import ordinal

    df = spark.createDataFrame([("a", 5), ("a", 40_000), (None, 3), (None, 1), ("a", None)], "g string, x long")
    got = sorted(((r.g or "", r.x or -1, r.idx) for r in ordinal(df, ["g"], "x", ["x"]).collect()))
    assert got == [("", 1, 0), ("", 3, 1), ("a", -1, 0), ("a", 5, 1), ("a", 40_000, 2)]


def test_ortholog_groups_count_the_links(spark):
    """Counted links against the links themselves, with proteins of no id, no hit partner and equal sequences."""
    rng = random.Random(6)
    kind = "genome_id string, protein_id string, strand string, phrog string, sha string, functional_module string"
    side = lambda p, n: spark.createDataFrame(
        [(f"g{rng.randint(0, 3)}", f"{p}{i}", rng.choice("+-"), rng.choice([None, "a", "b", "c"]), rng.choice(["x", "y", "z", None]), rng.choice([None, "m", "n"])) for i in range(n)], kind)
    q, r = side("q", 40).localCheckpoint(), side("r", 30).localCheckpoint()
    hits = spark.createDataFrame([(f"q{rng.randint(0, 45)}", f"r{rng.randint(0, 35)}", 1e-9, 0.9, 0.9) for _ in range(80)], "q_id string, r_id string, evalue double, qcov double, tcov double")
    links, groups = fm.ortholog_links(q, r, hits).localCheckpoint(), fm.ortholog_groups(q, r, hits).localCheckpoint()
    counted = links.groupBy("q_id", "r_genome", "method").count()
    key = lambda rows: sorted(tuple(x) for x in rows)
    assert key(groups.select("q_id", "r_genome", "method", "links").collect()) == key(counted.collect())
    assert key(fm.group_synteny(q, groups, 4).collect()) == key(fm.synteny(q, r, links, 4).collect())


def test_imported_families_contract_representatives_only(spark, monkeypatch):
    """Members of one representative take no part in the contraction; a representative may be a member elsewhere or of itself."""
    r, seen = random.Random(3), []
    rows = [(f"R{r.randrange(60):02d}", f"M{i:04d}") for i in range(600)] + [(f"R{r.randrange(60):02d}", f"M{r.randrange(600):04d}") for _ in range(25)]
    rows += [("R01", "R01"), ("R02", "R61"), ("R61", "M9000"), ("R62", "R62"), ("R63", None), (None, "M9001")]
    whole = fm.component_roots
    monkeypatch.setattr(fm, "component_roots", lambda edges: seen.append(edges.count()) or whole(edges))
    got = {x.member_id: x.component for x in fm.imported_families(spark.createDataFrame(rows, "representative string, member string")).collect()}
    root = {x: x for row in rows for x in row}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        if a and b and find(a) != find(b):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert got == {x: find(x) if x else None for x in root}
    assert seen[0] <= 30


@pytest.mark.parametrize(("block", "tile"), [(16_384, 2048), (7, 4)])
def test_genome_sharing_shuffles_no_pairs(spark, block, tile):
    """Equal to all pairs compared; pairs leave the tasks that make them, so nothing is dealt or joined after them."""
    r = random.Random(6)
    rows = [(f"G{r.randrange(40)}", r.choice([None, *(f"F{i}" for i in range(50))])) for _ in range(260)] + [(None, "F1"), ("alone", "none"), ("empty", None)]
    out = fm.genome_sharing(spark.createDataFrame(rows, "genome_id string, family_id string"), block=block, tile=tile)
    sets, size = {}, {}
    for genome, family in rows:
        if genome:
            sets.setdefault(genome, set()).update({family} - {None})
            size[genome] = size.get(genome, 0) + 1
    want = {(a, b, size[a], size[b], len(x & y), len(x - y), len(y - x), round(len(x & y) / len(x | y), 9)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y}
    got = [(*x[:7], round(x[7], 9)) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Repartition") and "Join" not in plan
