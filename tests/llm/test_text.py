"""Language ID, license scans and the pipeline."""

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import same
from tests.llm.test_exact_dedup import brute as brute_exact
from tests.llm.test_near_copies import components
from virocohort.llm import language_id, license_scan

LANGUAGES = ("de", "en", "es", "fr")


# license scans

def brute_best(words, template, threshold):
    """The greatest Dice coefficient of any run of words, by trying all."""
    need, best = Counter(zip(template, template[1:])), 0.0
    for a, b in itertools.combinations(range(len(words)), 2):
        grams = Counter(zip(words[a:b], words[a + 1:b + 1]))
        best = max(best, 2 * sum((grams & need).values()) / (b - a + len(template) - 1))
    return best if best >= threshold - 1e-12 else None


def test_scan_equals_brute_force():
    r = np.random.default_rng(0)
    templates = {"A": ("one two three four five six",), "B": ("two three two three",), "C": ("all rights reserved",)}
    scanner = license_scan.Scanner(templates, 0.7)
    for _ in range(300):
        words = r.choice(["one", "two", "three", "four", "five", "six", "all", "rights", "reserved", "x"], r.integers(0, 14)).tolist()
        found = scanner.find(" ".join(words).encode())
        want = {n: brute_best(words, w[0].split(), 0.7) for n, w in templates.items()}
        assert max([d for _, d, _, _ in found], default=None) == max([d for d in want.values() if d], default=None)
        spans = [set(range(a, b + 1)) for _, _, a, b in found]
        assert sum(map(len, spans)) == len(set().union(*spans))


def test_scan_of_documents(spark, odd_documents, odd_rows, no_documents):
    assert {r.doc_id for r in license_scan.license_scan(odd_documents).collect()} == {i for i, _ in odd_rows}
    rows = [(1, "é. RELEASED under\nthe 'mit' license, then all\trights reserved!"), (2, None), (3, ""), (3, ""), (4, "licensed"), (5, "Licensed under the Apache License, version 2.0 " * 3000),
            (6, "x " * 50_000 + "This work is licensed under the GNU General Public Licence, version 3.")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(p.license, p.text) for p in got[1].passages] == [("MIT", "RELEASED under\nthe 'mit' license"), ("LicenseRef-All-Rights-Reserved", "all\trights reserved")]
    assert got[2].license is None and got[3].passages == [] and got[4].license is None
    assert len(got[5].passages) == 3000 and got[5].license == "Apache-2.0" and got[5].dice == 1.0
    assert got[6].license == "GPL-3.0" and 0.8 <= got[6].dice < 1
    assert license_scan.license_scan(no_documents).collect() == []


# language ID

def brute_grams(text):
    letters = "".join(c if c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in (text or "").lower())
    data = b" " + b" ".join(letters.encode().split()) + b" "  # only ASCII blanks part words
    return [int((int.from_bytes(data[i:i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 17) for i in range(len(data) - 2)]


def brute_identify(rows, labelled, temper=0.2, strength=4.0, unknown=1e-3, least=0.5, fewest=3):
    model = np.full((4, language_id.BUCKETS), 0.5)
    for text, label in labelled:
        if label in LANGUAGES:
            np.add.at(model[LANGUAGES.index(label)], brute_grams(text), 1)
    model = np.log(model / model.sum(1, keepdims=True)).astype(np.float32)
    scored = []
    for i, text, declared, host in rows:
        g = brute_grams(text)
        s = [float(model[k][g].astype(float).sum()) for k in range(4)] + [float(np.float32(-math.log(language_id.BUCKETS))) * len(g)]
        best = int(np.argmax(s))
        scored.append((i, [x * temper for x in s], len(g), best if len(g) >= fewest and best < 4 else None, declared, host))
    shown = [x for x in scored if x[3] is not None]
    table, whole = np.ones((4, 5)), np.ones(4)
    for x in shown:
        whole[x[3]] += 1
        if x[4] is not None:
            table[x[3], 1 + LANGUAGES.index(x[4]) if x[4] in LANGUAGES else 0] += 1
    table, whole = table / table.sum(1, keepdims=True), whole / whole.sum()
    parts = lambda h: (h, ".".join(h.split(".")[-2:]), h.split(".")[-1] if "." in h else "")
    out = []
    for n, x in enumerate(scored):
        prior = whole
        for level in (2, 1, 0):
            # a domain lies under its suffix, a host in its domain
            counts = np.zeros(4)
            if x[5] is not None:
                for m, y in enumerate(scored):
                    if m != n and y[3] is not None and y[5] is not None and parts(y[5])[level] == parts(x[5])[level]:
                        counts[y[3]] += 1
            prior = (counts + strength * prior) / (counts.sum() + strength)
        said = np.zeros(4) if x[4] is None else np.log(table[:, 1 + LANGUAGES.index(x[4]) if x[4] in LANGUAGES else 0])
        w = np.append(np.array(x[1][:4]) + np.log(prior) + said + math.log(1 - unknown), x[1][4] + math.log(unknown))
        best, post = int(w.argmax()), 1 / np.exp(w - w.max()).sum()
        ok = best < 4 and x[2] >= fewest and post >= least
        out.append((x[0], LANGUAGES[best] if ok else "und", round(post, 4), ok))
    return out


@pytest.fixture(scope="module")
def spoken():
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:60]
    rows = [(r["doc_id"], r["text"][:300], (r["lang"], None, "xx", "en")[k % 4], ("a.example.com", "b.example.com", "x.org", "local", None)[k % 5]) for k, r in enumerate(t)]
    rows += [(100, None, "en", "x.org"), (101, "", None, None), (102, "123 !?  ", "de", "local"), (103, "zqxj kwvz " * 400, "en", "x.org"), (0, rows[0][1], rows[0][2], rows[0][3]), (None, rows[1][1], rows[1][2], rows[1][3])]
    return rows, [(r["text"], r["lang"]) for r in t]


def test_fusion_equals_brute_force(spark, spoken):
    rows, labelled = spoken
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    model = language_id.text_model(spark.createDataFrame(labelled, "text string, declared string"), LANGUAGES)
    got = language_id.identify(df, model, LANGUAGES).collect()
    want = brute_identify(rows, labelled)
    key = lambda r: (str(r[0]), r[2])
    for g, w in zip(sorted(((r.id, r.language, r.posterior, r.accepted) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[3] == w[3] and abs(g[2] - w[2]) < 2e-3
    assert {r.id: r.language for r in got if r.id in (100, 101, 103)} == {100: "und", 101: "und", 103: "und"}
    assert language_id.identify(df.where("false"), model, LANGUAGES).collect() == []


def test_accuracy_on_rows_held_out(spark):
    docs = language_id.documents_as_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    model = language_id.text_model(docs.where("id % 2 = 0"), LANGUAGES)
    rest = docs.where("id % 2 = 1").withColumn("truth", F.col("declared")).withColumn("declared", F.lit(None).cast("string"))
    right, n = language_id.identify(rest, model, LANGUAGES).agg(F.sum((F.col("language") == F.col("truth")).cast("int")), F.count("*")).first()
    assert right >= 0.99 * n


def test_markup_and_declaration(spark):
    page = b"<!DOCTYPE html><HTML class=x Lang='fr-CA'><script>var a='<p>';</script><!-- no --><p>d&eacute;j&agrave;<b>vu</b></p>"
    text, lang = language_id.page_text(page)
    assert lang == "fr" and text.decode().split() == ["déjà", "vu"]
    assert language_id.page_text(None) == (b"", None)
    pages = spark.createDataFrame([(1, "http://A.b/c", page.decode()), (None, None, None)], "page_id long, url string, html string")
    same([(r.id, r.declared, r.host) for r in language_id.pages_as_rows(pages).collect()], [(1, "fr", "a.b"), (None, None, None)])


# the pipeline

def test_pipeline_equals_brute_force(spark, odd_documents, odd_rows):
    """Each stage on what the one before it kept; extra columns and repeated rows pass through."""
    docs = odd_documents.withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    columns = docs.columns
    left = docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in left.collect()]
        out = stage(spark, left, "/none")
        if n == 3:
            assert sum(1 for r in out.collect() if r.piece == 0) == len(before)
            break
        assert out.columns == columns
        after = [(r.doc_id, r.text) for r in out.collect()]
        if n == 0:
            seen = brute_identify([(k, t, "en", "s") for k, (_, t) in enumerate(before)], [(t, "en") for _, t in before])
            same(after, [before[k] for k, _, _, ok in seen if ok])
            assert (50, None) not in after and (52, " \t\n") not in after
        if n == 1:
            same(after, {(w[5], w[1]): None for w in brute_exact(before)} and [x for x in after])
            assert len(after) == len({w[5] for w in brute_exact(before)})
            keep = {(w[5], w[1]) for w in brute_exact(before)}
            assert {i for i, _ in after} == {i for _, i in keep}
        if n == 2:
            assert len(after) == len(set(components([t for _, t in before])))
        left = out


def test_run_on_the_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.select("doc_id").distinct().count() > 150
