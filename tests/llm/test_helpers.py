import re
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import components as star
from corpusloom.llm import secrets, toxicity
from corpusloom.llm._filters import filter_of, passes
from corpusloom.llm._words import Words, slices
from corpusloom.llm.components import components
from corpusloom.session import cut

TEXT = st.text(alphabet=st.sampled_from(list("aAbB zZ\t\n\x0b\r\x1c\x85é漢😀.")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    expected = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    known: dict[int, str] = {}
    for lo, hi, raw, bounds in slices(pa.array(texts, pa.string()), limit=64):
        words = Words(raw, bounds)
        for d in range(hi - lo):
            found = [bytes(words.lower[a:b]).decode() for a, b in zip(words.start[words.first[d] : words.first[d + 1]], words.end[words.first[d] : words.first[d + 1]], strict=True)]
            assert found == expected[lo + d]
            for h, w in zip(words.hash[words.first[d] : words.first[d + 1]].tolist(), found, strict=True):
                assert known.setdefault(h, w) == w


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("iIdDoOtT10!аіо ")), max_size=20))
def test_folding_never_fails(text):
    assert toxicity.fold(toxicity.fold(text)) == toxicity.fold(text)


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(1, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    links = spark.createDataFrame([*pairs, (None, 1), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {x: find(x) for x in root}
    assert components(links.limit(0)).count() == 0


def test_components_of_few_links_take_no_further_rounds(spark, monkeypatch):
    """However long the paths are: every round costs the driver four plans."""
    cuts = []
    monkeypatch.setattr(star, "cut", lambda df: cuts.append(1) or cut(df))
    links = spark.createDataFrame([(i, i + 1) for i in range(700)] + [(3000 - i, 2999 - i) for i in range(500)], "a long, b long")
    assert {r.component for r in components(links).collect()} == {0, 2500}
    assert len(cuts) == 4


def test_links_of_a_task_are_joined_in_blocks(monkeypatch):
    rng = np.random.default_rng(9)
    pairs = rng.integers(0, 400, (300, 2))
    batches = [pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 7].max(axis=1)), pa.array(pairs[i : i + 7].min(axis=1))], names=["u", "v"]) for i in range(0, 300, 7)]

    def groups(edges):
        own = {x: x for e in edges for x in e}
        while any(own[a] != own[b] for a, b in edges):
            for a, b in edges:
                own[a] = own[b] = min(own[a], own[b])
        return {x: y for x, y in own.items() if any(x in e and e[0] != e[1] for e in edges)}

    for held in (1, 16, 1 << 16):
        monkeypatch.setattr(star, "HELD", held)
        made = [(u, v) for b in star._forests(iter(batches)) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
        assert all(u > v for u, v in made)
        assert groups(made) == groups(pairs.tolist())
    assert len(made) == len({u for u, _ in made})


def test_filter_has_no_false_absence(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = filter_of(df, "h")
    assert passes(bits, np.array([r.h for r in df.collect()])).all()
    others = np.array([r.h for r in spark.range(10**6, 10**6 + 3000).select(F.xxhash64("id").alias("h")).collect()])
    assert passes(bits, others).mean() < 0.01


def test_long_text_of_secrets(make):
    n = 200_000
    text = "é " + " ".join(f"token=value{i:06d}" for i in range(n))
    began = time.time()
    row = secrets.scan(make([(1, text), (2, "token=value000000")])).where("doc_id = 1").first()
    spans = row.spans.split(",")
    assert row.n_assign == n and row.n_live + row.n_shared == n and spans == [f"assign:{2 + 18 * i}:{19 + 18 * i}" for i in range(n)]
    assert time.time() - began < 60


def test_widely_copied_secrets(spark):
    """Shared by three owners, or by two with six repositories; one owner's own stays live."""
    rows = [(i, f"token=value{k}xx", f"o{o}", f"r{r}") for i, (k, o, r) in enumerate([*((1, o, 0) for o in range(3)), *((2, r % 2, r) for r in range(6)), *((3, 0, r) for r in range(9)), (4, 0, 0), (4, 1, 0)])]
    found = secrets.find(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    got = {r.n_documents: (r.n_owners, r.n_repositories, r.verdict) for r in secrets.ownership(found).collect()}
    assert got == {3: (3, 3, "shared"), 6: (2, 6, "shared"), 9: (1, 9, "live"), 2: (2, 2, "live")}
