import re
from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import near_dup
from corpusloom.llm._words import Words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    shared = Counter((a, b) for ids in held.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_against_brute_force(documents):
    rows = near_dup.near_duplicates(documents).collect()
    expected = brute([(r.doc_id, r.text) for r in documents.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chain_of_near_copies(make):
    """Each is near the next, the ends are not near each other; a large group of copies too."""
    base = [f"t{i}" for i in range(100)]
    texts = []
    for step in range(12):
        texts.append((100 + step, " ".join(base)))
        base = base[:8 * step] + [f"n{step}"] + base[8 * step + 1 :]
    texts += [(i, "the same few words again here") for i in range(200, 500)]
    expected = brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(make(texts)).collect()}
    assert got == expected
    assert near_dup.keep_one(make(texts)).count() == len({c for _, c in expected.values()})


def test_words_and_shingles():
    texts = ["A bÄ c", "", "x", "p q r s t u\x0bv", "\x0b \n"]
    raw = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    words = Words(np.frombuffer(raw, np.uint8), bounds)
    assert np.diff(words.first).tolist() == [3, 0, 1, 7, 0]
    hashes, first = words.shingles(5)
    assert np.diff(first).tolist() == [1, 0, 1, 3, 0] and len(set(hashes.tolist())) == 5


def test_signature_agrees_with_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = x[:3500], x[500:]  # 3000 of 4000 in common
    (l1, h1), (l2, h2) = near_dup.signature(a), near_dup.signature(b)
    assert 0.6 < np.mean(np.concatenate([l1 == l2, h1 == h2])) < 0.9
    assert near_dup.recall_miss(0.75) < 1e-5


def test_rows_of_cells_are_in_proportion_to_members(spark):
    """A bucket of 100,000 members of one component and a stranger; then one of two halves."""
    m = 100_000
    member = spark.range(m).selectExpr("id AS rep", "1L AS band", "0 AS number", f"{m}L AS m", "0L AS top", f"{m - 1}L AS n_top", f"IF(id = {m - 1}, id, 0) AS component")
    assert near_dup.cells(member, near_dup.SET_BLOCK).count() <= 1.1 * m and near_dup.cells(member, near_dup.BLOCK).count() <= 1.1 * m
    halves = spark.range(400).selectExpr("id AS rep", "1L AS band", "0 AS number", "400L AS m", "0L AS top", "150L AS n_top", "IF(id < 150, 0, IF(id < 250, 150, id)) AS component")
    pairs = Counter()
    held = defaultdict(list)
    for r in near_dup.cells(halves, 30).collect():
        held[r.cell].append((r.part, r.rep, r.component))
    for rows in held.values():
        for k, (part, rep, comp) in enumerate(rows):
            pairs.update((min(rep, b), max(rep, b)) for p, b, c in rows[k + 1 :] if comp != c and (part < 0 or p != part))
    comps = {r.rep: r.component for r in halves.collect()}
    assert pairs == Counter((a, b) for a in comps for b in comps if a < b and comps[a] != comps[b])


def test_groups_in_one_bucket_are_compared_in_full(make, monkeypatch):
    """Many texts of which most words are the same, in groups that are and are not alike enough."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "SET_BLOCK", 3)
    rng = np.random.default_rng(21)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(90):
        own = list(base)
        lo = 0 if i % 3 else 60
        for j in rng.choice(14, int(rng.integers(2, 6)), replace=False):
            own[lo + 4 * int(j)] = f"x{i // 30}"
        texts.append((i, " ".join(own)))
    expected = brute(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(make(texts)).collect()}
    assert got == expected and 1 < len({c for _, c in expected.values()}) < 90


def test_recall_near_the_threshold():
    """Pairs of similarity 0.75 to 0.76: the share that no band or the sketch would lose."""
    rng = np.random.default_rng(22)
    lost, tried = 0, 1_500
    for _ in range(tried):
        n = int(rng.integers(20, 400))
        both = int(np.ceil(0.75 * 2 * n / 1.75))  # of two sets of n
        x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        (b1, s1), (b2, s2) = near_dup.summary(x[:n]), near_dup.summary(x[n - both :])
        lost += not (b1 == b2).any() or (s1 == s2).sum() <= near_dup.LEAST_AGREED
    assert lost <= 2
