"""Language identification: held-out accuracy, kernel by brute force, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language as l


def sets(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    low = b" " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in low) + b" "
    return {low[i : i + n] for n in (2, 3, 4) for i in range(len(low) - n + 1)}


def test_kernel_by_brute_force():
    texts = ["The cat", "the CAT, sat!", "", "ça va où", "x", "9" * 5, "the " * 300, "où ça"]
    kernel = l.kernel_of(pa.array(texts), 1 << 16)
    space = {g for g in set().union(*map(sets, texts)) if sum(g in sets(t) for t in texts) > 1}
    assert len(kernel.codes) == len(space)
    _, _, raw, bounds = next(l.slices(pa.array(texts)))
    size = lambda t: max(1, len(sets(t) & space))
    want = [[len(sets(a) & sets(b) & space) / np.sqrt(size(a) * size(b)) for b in texts] for a in texts]
    assert np.allclose(kernel.rows(raw, bounds), want, atol=1e-5)


def test_regression_in_closed_form():
    """With every learned text a landmark, kernel ridge regression is solved exactly."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 30)).astype(np.float32)
    gram = x @ x.T
    of = np.repeat([0, 1], 20)
    w = l.fit(l.Kernel(np.zeros(0, np.uint64), x.T.copy()), gram, of, 2, 0.5)
    f = gram.astype(np.float64) @ w[:-1] + w[-1]
    residual = np.eye(2)[of] - f
    assert np.allclose(residual.sum(axis=0), 0, atol=1e-3) and np.allclose(gram @ (residual - 0.5 * w[:-1]), 0, atol=1e-2)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(docs):
    got = {r.doc_id: r for r in l.identify(docs, l.learn(docs)).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = []
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= g.score <= 1
        if g.held_out and r.lang is not None:
            right.append(g.lang_pred == r.lang)
    assert len(right) > 200 and np.mean(right) >= 0.98


def test_learns_from_nothing_held_out(docs):
    """Labels of held-out rows may be anything: the predictions stay; lang is no input."""
    wrong = docs.withColumn("lang", F.when(l.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    one, two = (sorted(tuple(r) for r in l.identify(d, l.learn(d)).collect()) for d in (docs, wrong))
    assert one == two


def test_odd_texts(spark, make, docs):
    model = l.learn(docs)
    rows = [(1, None), (2, ""), (3, "123 -- !"), (4, "the"), (None, "die und der"), (6, "é"), (6, "é"), (7, "the of and " * 100_000)]
    got = l.identify(make(rows), model).collect()
    assert [r.lang_pred == l.UNKNOWN for r in got] == [True, True, True, False, False, False, False, False]
    assert got[5] == got[6] and [r.held_out for r in got if r.doc_id is None] == [False]
    assert all(0 <= r.score <= 1 for r in got)


def test_no_labels(make):
    rows = make([(1, "some text"), (2, None)])
    none = rows.withColumn("lang", F.lit(None).cast("string"))
    assert l.learn(none) is None
    assert [(r.lang_pred, r.score) for r in l.identify(none, None).orderBy("doc_id").collect()] == [("und", 0.0), ("und", 1.0)]
