"""The field against enumeration of labellings; held-out accuracy; odd texts."""

import itertools
import math

import numpy as np
import pytest

from virocohort.llm import line_quality as lq


@pytest.mark.parametrize("n", [1, 2, 5])
def test_marginals_equal_enumeration(n):
    r = np.random.default_rng(n)
    good, moves = r.normal(size=n) * 3, r.normal(size=(2, 2))
    weight = {y: math.exp(sum(good[t] for t in range(n) if y[t]) + sum(moves[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=n)}
    total = sum(weight.values())
    marginal, pairs, log_total = lq.forward_backward(good, moves)
    assert np.allclose(marginal, [sum(w for y, w in weight.items() if y[t]) / total for t in range(n)])
    assert math.isclose(log_total, math.log(total))
    want = np.zeros((2, 2))
    for y, w in weight.items():
        for a, b in zip(y, y[1:]):
            want[a, b] += w / total
    assert np.allclose(pairs, want)


def test_all_sequences_at_once():
    r = np.random.default_rng(1)
    lengths = np.array([7, 4, 4, 1])
    starts = np.cumsum(lengths) - lengths
    good, moves = r.normal(size=lengths.sum()), r.normal(size=(2, 2))
    marginal, pairs = lq._all_sequences(good, starts, lengths, moves)
    each = [lq.forward_backward(good[s:s + n], moves) for s, n in zip(starts, lengths)]
    assert np.allclose(marginal, np.concatenate([e[0] for e in each])) and np.allclose(pairs, sum(e[1] for e in each))


@pytest.mark.parametrize(("sf", "accuracy"), [("sf0.01", 0.95), ("sf0.1", 0.99)])
def test_held_out_accuracy(spark, sf, accuracy):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    unseen = lq.quality(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(unseen) > 50 and np.mean([r.predicted == r.quality for r in unseen]) > accuracy


def test_labels_of_held_out_documents_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = lq.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end quality")
    again = {r.doc_id: r.score for r in lq.quality(docs, turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_odd_documents(spark, odd_documents, odd_rows, no_documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = lq.quality(odd_documents, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    none = {round(r.score, 12) for r in got if r.doc_id in (50, 51, 52)}
    assert len(none) == 1
    assert lq.quality(no_documents, labels).collect() == []
    assert len(lq.quality(odd_documents, labels.where("false")).collect()) == len(odd_rows)


def test_neighbouring_lines_count():
    """The same line is judged by the lines around it."""
    good, bad = b"a plain line of words here", b"| | | | $$$ ### |"
    field = lq.fit([(1, b"\n".join([good] * 6)), (0, b"\n".join([bad] * 6))] * 20)
    unclear = b"one two"
    alone = [lq.forward_backward(field.weights[lq.observed(lq.measures(t)[0], field.edges)].sum(axis=1), field.moves)[0][1] for t in (b"\n".join([good, unclear, good]), b"\n".join([bad, unclear, bad]))]
    assert alone[0] > alone[1] + 0.5
