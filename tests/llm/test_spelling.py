"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import same
from virocohort.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows, least=6, often=5, ratio=5, every=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= often}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()]


@pytest.fixture(scope="module")
def rows():
    """Words with planted edits at falling frequencies, chains of them, ties, letters outside ASCII, one very long word."""
    r = random.Random(3)
    letters = "abcdeñéßÀÖ"
    out = []
    for _ in range(60):
        word, n = "".join(r.choice(letters) for _ in range(r.randint(6, 11))), r.choice((700, 300, 60, 60))
        while n >= 5:
            out += [word] * n
            at, kind = r.randrange(len(word)), r.randrange(3)
            word = word[:at] + ("" if kind == 0 else r.choice(letters)) + word[at + (kind != 2):]
            n //= r.choice((2, 5, 6))
    long = "ab" * 4000
    out += [long] * 40 + [long[:-1]] * 6
    r.shuffle(out)
    return [(i if i % 50 else None, r.choice((" ", ", ", "1")).join(out[i::400])) for i in range(400)] + [(5, None), (6, ""), (7, "abc")]


@pytest.mark.parametrize("filter_bytes", [32 << 20, 256])
def test_equals_brute_force(spark, rows, filter_bytes):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.variants(docs, every=7, filter_bytes=filter_bytes).collect()
    want = brute(rows, every=7)
    assert sum(w[1] is not None for w in want) > 20 and max(w[4] for w in want) > 2
    same([tuple(r) for r in got], want)


def test_odd_documents(spark, odd_documents, odd_rows, no_documents):
    same([tuple(r) for r in spelling.variants(odd_documents, least=3, often=2).collect()], brute(odd_rows, 3, 2))
    assert spelling.variants(no_documents).collect() == []


def test_hash_of_an_edit_is_that_of_the_edited_word():
    for word in ("straßen", "aabbcc"):
        h = spelling._hashes(spelling._codes([word], len(word)))
        assert h == spelling._hashes(spelling._codes([word, "x" * len(word)], len(word)))[0]
    assert spelling._hashes(np.array([[97, 98]])) != spelling._hashes(np.array([[98, 97]]))


def test_passes_stay_in_their_bytes():
    plans = spelling.passes({6: 1000, 7: 100_000, 8: 10}, 4096)
    assert all(sum(hi - lo for *_, lo, hi in p) * 64 <= 4096 for p in plans)
    for length, words in ((6, 1000), (7, 100_000), (8, 10)):
        ranges = sorted((lo, hi) for p in plans for x, _, lo, hi in p if x == length)
        assert ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:])) and ranges[-1][1] * 512 >= words * 12
