"""The pipeline, each stage against a brute-force version on its own input."""

import collections

import corpus_pipeline
from corpusloom.llm import line_dedup, mixing, near_dup
from tests.compare import rows

from .test_near_dup import brute
from .test_operators import multiset


def test_every_stage(spark, sf_dir, tmp_path):
    import duckdb

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "mixing":
            assert docs.columns == names

    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"][1].collect()}
    good = [i for i, r in labels.items() if r.quality == 1]
    assert sum(i in kept for i in good) / len(good) > 0.98 and sum(i in kept for i in labels) < len(labels)

    before, after = seen["lines"]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    expected = con.sql(line_dedup.SQL).df()[["doc_id", "text"]]
    assert rows(after.select("doc_id", "text").toPandas()) == rows(expected)

    before, after = seen["near_duplicates"]
    expected = {c for _, c in brute([(r.doc_id, r.text) for r in before.collect()]).values()}
    assert {r.doc_id for r in after.collect()} == expected

    before, after = seen["decontamination"]
    items = [multiset(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    sizes = [sum(m.values()) for m in items]
    for r in before.collect():
        words, leak = multiset(r.text), False
        grams = list(words.elements())
        for m, n in zip(items, sizes, strict=True):
            if sum((words & m).values()) >= 0.75 * n:  # any window of the item's size
                order = [tuple(x) for x in _in_order(r.text)]
                leak = leak or any(_alike(collections.Counter(order[i : i + n]), m) for i in range(max(1, len(order) - n + 1)))
        assert leak != (r.doc_id in {d.doc_id for d in after.where(f"doc_id = {r.doc_id}").collect()}), (r.doc_id, len(grams))

    before, after = seen["mixing"]
    con.register("documents", before.toPandas())
    expected = con.sql(mixing.SQL).df().query("taken > 0")[["doc_id", "size", "taken"]]
    assert rows(after.select("doc_id", "size", "taken").toPandas()) == rows(expected)


def _in_order(text):
    w = [x.lower() for x in text.split()]
    return [w[i : i + 5] for i in range(max(1, len(w) - 4))]


def _alike(a, b):
    return sum((a & b).values()) >= 0.75 * sum((a | b).values())


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "taken"} <= set(out.columns) and out.count() > 50
    assert near_dup.BANDS * 2 == near_dup.PERMUTATIONS
