"""Collocations against a count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import same
from virocohort.llm import collocations


def brute(rows, top, least):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, totals[lang], -score))
    return out


@pytest.fixture(scope="module")
def rows():
    """Common and rare phrases, one hot leading word, hot repeated words, null languages, other letters and signs."""
    r = random.Random(4)
    words = ["".join(r.choice("abÉñ") for _ in range(r.randint(1, 3))) for _ in range(40)]
    out = []
    for i in range(300):
        text = " ".join(r.choice(words) if r.random() < 0.7 else "The " + r.choice(words) for _ in range(r.randint(0, 60)))
        text += r.choice(("", ". New York City hall", "\nof the of the of the of the", "\tla la la la la la la", " x\x0b!y  z"))
        out.append((r.choice(("en", "en", "de", None, "")), text))
    return [*out, ("en", None), (None, ""), ("fr", "solo")]


@pytest.mark.parametrize(("group", "top"), [(200_000, 2000), (40, 7)])
def test_equals_brute_force(spark, rows, group, top):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(docs, top, least=5, group=group).collect()
    want = brute(rows, top, 5)
    assert len(want) > 20
    same([tuple(r) for r in got], want)


def test_odd_documents(spark, odd_documents, odd_rows, no_documents):
    got = collocations.collocations(odd_documents.withColumnRenamed("slot", "lang"), least=3).collect()
    same([tuple(r) for r in got], brute([("clash", t) for _, t in odd_rows], 2000, 3))
    assert collocations.collocations(no_documents.selectExpr("text", "text lang")).collect() == []


def test_counts_beyond_64_bits(spark):
    """1000 a n and l r pass 64 bits; the score is exact."""
    big = 10**13 - 7
    got = spark.sql(f"select {collocations.EXACT} s from values (cast({big} as bigint), cast({10 * big} as bigint), cast({big + 5} as bigint), cast({big + 9} as bigint)) as x(a, n, l, r)").first().s
    assert got == 1000 * big * 10 * big // ((big + 5) * (big + 9))
