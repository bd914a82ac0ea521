"""Pruned sums against all sums, and what keyword search makes of odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from corpusloom.operators import impacts, retrieval


def _met(rng, docs: int, terms: int, queries: int, k: int, piece: int, skew: float, tied: bool = False):
    """The k best by Impacts and by a dense product, and the block."""
    chance = 1 / np.arange(1, terms + 1) ** skew
    held = rng.random((docs, terms)) < np.minimum(chance * 3, 0.9)
    weight = np.where(held, 1.0 if tied else rng.uniform(0.5, 2.2, (docs, terms)), 0.0)
    asked = np.zeros((queries, terms))
    for q in range(queries):
        asked[q, rng.choice(terms, 8, replace=False, p=chance / chance.sum())] = rng.integers(1, 3, 8)
    gain = asked * (1.0 if tied else np.log(docs / (held.sum(axis=0) + 0.5) + 1))
    keys = rng.permutation(docs).astype(np.int64) * 3
    of, term = np.nonzero(asked)
    block = impacts.Impacts(of, term, gain[of, term], queries, k)
    for lo in range(0, docs, piece):
        row, which = np.nonzero(weight[lo : lo + piece])
        block.add(impacts.Postings(keys[lo : lo + piece], row, which, weight[lo : lo + piece][row, which]))
    every, wanted = np.round(gain @ weight.T, 9), []
    for q in range(queries):
        wanted.append([(keys[i], pytest.approx(every[q, i], abs=1e-8)) for i in np.lexsort((keys, -every[q]))[:k] if every[q, i] > 0])
    got = [[(key, s) for key, s in zip(block.best.keys[q].tolist(), block.best.scores[q].tolist(), strict=True) if np.isfinite(s)] for q in range(queries)]
    return got, wanted, block


@pytest.mark.parametrize("look", [0, 8, 1 << 30])
@pytest.mark.parametrize("tied", [False, True])
def test_the_best_are_those_of_all_sums(monkeypatch, look, tied):
    """By looking postings up, by reading them in order, and by whichever is cheaper."""
    monkeypatch.setattr(impacts, "_LOOK", look)
    monkeypatch.setattr(impacts, "_PRODUCTS", 500)
    got, wanted, _ = _met(np.random.default_rng(4), 700, 60, 25, 6, 90, 0.8, tied)
    assert got == wanted


def test_few_are_summed_in_full():
    """Words by Zipf's law, as in texts: fewer than a tenth of all pairs are summed."""
    got, wanted, block = _met(np.random.default_rng(5), 20000, 2000, 20, 10, 1000, 1.0)
    assert got == wanted and block.met == 400_000
    assert block.summed < block.met / 10


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "one two", 5), (2, None, 6), (3, "", 7), (None, "one", 8), (4, "two two", 9)], "doc_id long, text string, h int")
    asked = spark.createDataFrame([(1, "one"), (1, "two"), (2, None), (3, "none of these"), (None, "two"), (4, "one two")], "query_id long, query_text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(docs, asked, 5).collect()}
    assert set(got) == {(1, 1), (1, 4), (4, 1), (4, 4)} and got[1, 1] == got[4, 1] and got[1, 4] == got[4, 4]
    for left, right in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.limit(0), asked.limit(0))):
        assert retrieval.bm25(left, right, 5).collect() == []
        vectors = left.selectExpr("doc_id AS vec_id", "array(1D) AS embedding")
        assert (retrieval.nearest(vectors, right.selectExpr("query_id", "array(1D) AS query_vector"), 5).collect() == []) == (left.isEmpty() or right.isEmpty())
