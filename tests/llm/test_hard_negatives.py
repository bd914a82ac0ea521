"""Hard negatives against all pairs in plain Python."""

import math

import numpy as np
import pytest

from corpusloom.llm import hard_negatives as h

SHAPE = "vec_id long, label int, embedding array<float>, score double, slot int, key string"


def brute(rows, every=50, positives=5, negatives=3):
    ok = [(i, c, [math.floor(256 * float(np.float32(x))) for x in v]) for i, c, v in rows if None not in (i, c, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, c, v in ok:
        if i % every:
            continue
        near = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, d, w in ok if j != i and len(w) == len(v)))
        for s, p, _ in [x for x in near if x[2] == c][:positives]:
            found = [(-t, n) for t, n, d in near if d != c and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, p, r + 1, n, -s, t) for r, (t, n) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1.0, 1, "x") for r in rows], SHAPE)
    return sorted(tuple(r) for r in h.mine(df, df.where("vec_id % 50 = 0"), **more).collect())


@pytest.mark.parametrize("steps", [3, 40, 400])
def test_against_all_pairs(spark, steps):
    """Few steps of components make many ties, of positives' limits as well."""
    rng = np.random.default_rng(steps)
    rows = [(i, int(rng.integers(3)), [float(x) / steps for x in rng.integers(-steps // 3, steps, 6)]) for i in range(400)]
    rows += [(1000, 1, None), (None, 1, [1.0] * 6), (1001, None, [1.0] * 6), (1002, 1, [1.0] * 5 + [None]), (1050, 1, [1.0] * 5 + [float("nan")]), (1100, 1, [float("inf")] * 6)]
    rows += [(1150, 2, [0.5] * 4), (1151, 2, [0.5, 1.0, 1.0, 0.5]), (1152, 0, [0.4] * 4), (1200, 2, []), (1201, 2, []), (1202, 0, [])]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_negative_and_zero_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.7, 0.0]), (50, 3, [0.0, 1.0]), (3, 3, [1.0, 0.0]), (4, 1, [1.0, 0.0]), (5, 2, [0.0, -1.0])]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert (50, 3, 1, 0, 0, 0) in got  # a positive at 0 takes those at 0


def test_blocks_of_anchors_and_large_numbers(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(2)), rng.normal(size=4).tolist()) for i in range(600)]
    whole = mined(spark, rows)
    monkeypatch.setattr(h, "BLOCK", 60)
    assert mined(spark, rows) == whole == brute(rows)
    big = [(i, i % 2, [1e5 * (i + 1), 3.0]) for i in range(60)]
    assert mined(spark, big)  # scores beyond 2 ** 53: defined, and no overflow


def test_limits_in_whole_numbers(spark):
    df = spark.createDataFrame([(s,) for s in (*range(-300, 301), 2**62, -(2**62))], "score long")
    from pyspark.sql import functions as F

    for r in df.select("score", h._limit(95, F.col("score"), False).alias("upper"), h._limit(50, F.col("score"), True).alias("lower")).collect():
        assert (r.upper, r.lower) == (95 * r.score // 100, -(-50 * r.score // 100))


def test_empty_and_repeated(spark):
    assert mined(spark, []) == []
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (2, 2, [0.9])]
    assert mined(spark, rows) == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 2, 65536, 58880)]
