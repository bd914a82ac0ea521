"""Ranked search against plain Python, and what its bounds leave out."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import lexical as x

from .conftest import words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    texts = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n, total = len(texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in texts:
            tf = Counter(t)
            m = 25 + 75 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in TERM.findall((text or "").translate(LOW)) if tf[w])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, make, docs, items, k=10):
    table = make(docs)
    return sorted(tuple(r) for r in x.search(x.build(table), table, spark.createDataFrame(items, "item_id long, text string"), k).collect())


def texts(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"T{int(w)}" for w in np.minimum(rng.zipf(1.3, rng.integers(1, 120)), vocabulary))) for i in range(n)]


def test_against_plain_python(spark, make):
    docs = texts(600, 3) + [(700, None), (701, ""), (702, "!!"), (703, "é漢字 T5, t5-T7"), (None, "t1 t2 t399"), (704, "t9 " * 30_000), (5, "t3 t4 t5"), (5, "t3 t4 t5")]
    items = [(i, t) for i, t in texts(40, 9)] + [(100, None), (101, ""), (102, "unseen words"), (103, "É漢字"), (104, "漢字 t7 T7 t7"), (105, "é漢字")]
    got = found(spark, make, docs, items)
    assert got == brute(docs, items) and len(got) > 380


def test_blocks_of_items_and_of_documents(spark, make, monkeypatch):
    docs, items = texts(300, 5), texts(30, 6)
    want = brute(docs, items, 3)
    assert found(spark, make, docs, items, 3) == want
    monkeypatch.setattr(x, "ITEM_TERMS", 200)
    assert found(spark, make, docs, items, 3) == want


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(0, words(80, 1)), (1, "token"), (None, "one"), (2, "one"), (2, "two")], "item_id long, text string")
    got = [tuple(r) for r in x.search(x.build(odd), odd, items).orderBy("item_id", "rank").collect()]
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert got == brute(docs, [(0, words(80, 1)), (1, "token"), (2, "one")])


def test_empty_items(spark, make):
    assert found(spark, make, texts(5, 1), []) == []


def test_bounds_hold_and_leave_out(spark, documents, sf_dir):
    """No bound is under the score, and most documents are left out."""
    import pyarrow as pa

    index = x.build(documents)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    asked = next(x._terms(iter(items.toArrow().combine_chunks().to_batches())))
    df = {r["term"]: r["df"] for r in index.frequency.collect()}
    of = x.Asked(pa.Table.from_batches([asked]), df, index.documents, index.total)
    text = {r.doc_id: r.text for r in documents.collect()}
    bounds, exact, n = [], [], 0
    for block in index.blocks.toArrow().to_pylist():
        upper = of.bounds(block)
        _, _, raw, at = next(x.slices(pa.array([text[i] for i in block["ids"]])))
        true = of.scores(raw, at)
        assert (upper >= true).all()
        bounds, exact, n = [*bounds, upper], [*exact, true], n + len(block["ids"])
    upper, true = np.concatenate(bounds, axis=1), np.concatenate(exact, axis=1)
    kth = np.sort(true, axis=1)[:, -10][:, None]
    reach = (upper >= np.maximum(kth, 1)).mean()
    assert n == sum(bool(TERM.search(t or "")) for t in text.values()) and reach < 0.25


def test_search_needs_the_signatures(spark, make):
    """Without blocks nothing is found: candidates come from the bounds alone."""
    table = make(texts(50, 2))
    index = x.build(table)
    index.blocks = index.blocks.where(F.lit(False))
    assert x.search(index, table, spark.createDataFrame(texts(5, 3), "item_id long, text string")).count() == 0
