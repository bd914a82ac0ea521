"""Decontamination against all windows of all documents."""

import time

import numpy as np
import pytest

from corpusloom.llm import decontaminate

from .conftest import words
from .test_operators import WORD, multiset


def test_decontamination_finds_every_window(spark, make):
    item = words(40, 9).split()
    edited = [*item[:20], "other", *item[21:]]
    docs = make([
        (1, words(100, 2) + " " + " ".join(item) + " " + words(100, 3)), (2, " ".join(item).upper()), (3, " ".join(item[:20]) + " " + words(30, 4)), (4, words(300, 5)),
        (5, words(33, 6) + "\n" + " ".join(edited) + " " + words(12, 7)), (6, "tiny item here and more"), (7, "a tiny item here"),
    ])
    items = spark.createDataFrame([(70, " ".join(item)), (71, "tiny item here"), (72, words(15, 8))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, items).collect()}
    assert set(found) == {(1, 70), (2, 70), (5, 70), (6, 71), (7, 71)}
    assert found[1, 70].start_word == 100 and found[1, 70].n_words == 40 and found[1, 70].similarity == 1
    one, other = multiset(" ".join(item)), multiset(" ".join(edited))
    assert found[5, 70].similarity == pytest.approx(sum((one & other).values()) / sum((one | other).values()))
    assert {r.doc_id for r in decontaminate.without_matches(docs, items).collect()} == {3, 4}


def test_multi_index_is_complete():
    rng = np.random.default_rng(3)
    for n, radius in ((50, 15), (300, 11), (5_000, 11)):
        index = decontaminate.Hamming(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), radius)
        prints = rng.choice(index.prints, 200)
        for _ in range(radius - 2):
            prints = prints ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
        found = set(zip(*map(np.ndarray.tolist, index.near(prints)), strict=True))
        distance = np.bitwise_count(prints[:, None] ^ index.prints[None, :])
        assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(distance <= radius)), strict=True)) and len(found) >= 200


def test_candidates_grow_slower_than_items():
    rng = np.random.default_rng(4)
    asked = rng.integers(0, 2**63, 200).astype(np.uint64)
    looked = {n: sum(len(w) for w, _ in decontaminate.Hamming(rng.integers(0, 2**63, n).astype(np.uint64), decontaminate.RADIUS).candidates(asked)) / len(asked) for n in (1_000, 4_000, 16_000)}
    assert looked[1_000] < 100 and looked[4_000] < 400 and looked[16_000] < 400 and looked[16_000] < 8 * looked[1_000], looked


def test_a_prompt_that_all_items_share(spark, make):
    """Documents that hold the prompt alone are looked at in time that items don't multiply."""
    prompt = words(40, 1)
    index = decontaminate.Index([([i], f"{prompt} {words(20, 100 + i)}") for i in range(3_000)], 5, 75, decontaminate.RADIUS)
    runs = index.tables[5, False]
    assert np.diff(runs.bounds).max() <= 12  # windows around a run
    docs = make([(1, f"{words(30, 5)} {prompt} {words(30, 6)}"), (2, f"{words(9, 7)} {prompt} {words(20, 107)}")])
    items = spark.createDataFrame([(i, f"{prompt} {words(20, 100 + i)}") for i in range(300)] + [(900, f"{prompt} {words(20, 107)}")] * 2, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()) == [(2, 7), (2, 900), (2, 900)]


def all_windows(docs, items):
    """The first of the best windows of every pair, by looking at all of them."""
    found = {}
    for d, text in docs:
        w = [x.lower() for x in WORD.findall(text or "")]
        for i, item in items:
            v = [x.lower() for x in WORD.findall(item or "")]
            n, k = min(len(w), len(v)), min(5, len(v))
            if not n:
                continue
            own = multiset(item, k)
            best = None
            for s in range(len(w) - n + 1):
                other = multiset(" ".join(w[s : s + n]), k)
                both = sum((own & other).values())
                alike = both / (own.total() + other.total() - both)
                if alike >= 0.75 and (best is None or alike > best[2]):
                    best = s, n, alike
            if best:
                found[d, i] = best
    return found


def test_all_windows(spark, make):
    """Edited, cut, repeated, shifted and short items; start, size and similarity are those of all windows."""
    rng = np.random.default_rng(16)
    some = lambda n, v=10**6: [f"v{i}" for i in rng.integers(0, v, n)]
    items, docs = [], []
    for i in range(48):
        n = int(rng.choice([2, 4, 5, 9, 20, 40, 90]))
        item = some(n, 10**6 if i % 3 else 6)  # every third one of few words, which repeat
        items.append((i, " ".join(item)))
        kind, cut_ = i % 6, max(1, n // 8)
        if kind == 1:
            item = item[cut_:]
        elif kind == 2:
            item = item[:-cut_] + some(2)
        elif kind == 3:
            item = item[: n // 2] + some(2) + item[n // 2 :]
        elif kind == 4:
            item = [*item[: n // 2], *item[n // 2 + 1 :]] + some(50) + item
        elif kind == 5:
            item = ["other" if j == n // 3 else x for j, x in enumerate(item)]
        docs.append((i, " ".join(some(int(rng.integers(0, 60)), 10**6 if i % 3 else 6) + item + some(int(rng.integers(0, 60))))))
    docs += [(100, items[4][1]), (101, None), (102, ""), (103, " ".join(x for _, x in items[:20]))]
    expected = all_windows(docs, items)
    found = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.matches(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found.keys() == expected.keys() and len(found) > 50
    for key, (s, n, alike) in expected.items():
        assert found[key][:2] == (s, n) and found[key][2] == pytest.approx(alike), key


def test_whole_tables(spark, documents, sf_dir):
    """The registered query's tables against all windows of documents that hold a run of the item."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    grams = {d: set(multiset(t or "")) for d, t in docs}
    expected = {}
    for i, item in items:
        own = set(multiset(item))
        expected |= all_windows([(d, t) for d, t in docs if len(grams[d] & own) >= 0.7 * len(own)], [(i, item)])
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words) for r in decontaminate.matches(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert got == {k: v[:2] for k, v in expected.items()} and len(got) > 2


def test_long_windows_are_taken_in_pieces(monkeypatch):
    rng = np.random.default_rng(17)
    hashes = rng.integers(0, 2**63, 5_000).astype(np.uint64)
    start, size = np.array([0, 10, 300, 7]), np.array([4_000, 40, 90, 1])
    one = decontaminate.fingerprints(hashes, start, size)
    monkeypatch.setattr(decontaminate, "_PIECE", 64)
    assert (decontaminate.fingerprints(hashes, start, size) == one).all()


def test_items_cut_at_their_edges_are_found(spark, make):
    rng = np.random.default_rng(15)
    some = lambda n: [f"v{i}" for i in rng.integers(0, 10**9, n)]
    items, docs = [], []
    for i in range(120):
        n = (40, 60, 100, 200)[i % 4]
        item, cut = some(n), (n - 4) // 7  # of n - 4 shingles a seventh is lost: similarity 0.75 or more
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(some(30) + (item[cut:] + some(cut) if i % 8 < 4 else item[:-cut] + some(30)))))
    found = decontaminate.matches(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(120)} and max(r.distance for r in found) > decontaminate.RADIUS


def test_candidates_come_from_the_index(spark, documents, sf_dir, monkeypatch):
    """Nothing is found if the multi-index finds nothing."""
    items = [([r.item_id], r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index = decontaminate.Index(items, 5, 75, decontaminate.RADIUS)
    text = " ".join(t for _, t in items).encode()
    words_ = decontaminate.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(index.search(words_)) >= len(items)
    monkeypatch.setattr(decontaminate.Hamming, "near", lambda self, prints: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert index.search(words_) == []


def test_recall_of_edited_items():
    """All windows of 0.75 or more: edited inside, cut at either edge or both, in texts long and
    short. The index finds nearly all of them; what it misses is counted."""
    rng = np.random.default_rng(23)
    some = lambda n: [f"v{i}" for i in rng.integers(0, 10**9, n)]
    items, docs = [], []
    for i in range(900):
        n = int(rng.integers(12, 160))
        item = some(n)
        items.append((i, " ".join(item)))
        made, kind = n - 4, i % 6
        lack = made - -(-150 * made // 175)
        lost = int(rng.integers(0, lack + 1))
        if kind == 0:  # cut at the begin
            text = some(40) + item[lost:] + some(40)
        elif kind == 1:  # at both edges
            left = int(rng.integers(0, lost + 1))
            text = some(40) + item[left : n - (lost - left)] + some(40)
        elif kind == 2:  # words replaced
            text = list(item)
            for _ in range(lack // 5):
                text[int(rng.integers(n))] = some(1)[0]
            text = some(40) + text + some(40)
        elif kind == 3:  # words put in
            text = list(item)
            for _ in range(lack // 5):
                text.insert(int(rng.integers(n)), some(1)[0])
            text = some(40) + text + some(40)
        else:  # a text shorter than the item
            short = made - -(-75 * made // 100)
            left = int(rng.integers(0, short + 1))
            text = item[left : n - (short - left)]
        docs.append((i, " ".join(text)))
    index = decontaminate.Index([([i], t) for i, t in items], 5, 75, decontaminate.RADIUS)
    expected, got = set(), set()
    for (i, item), (_, text) in zip(items, docs, strict=True):
        expected |= set(all_windows([(i, text)], [(i, item)]))
        raw = text.encode()
        got |= {(i, index.ids[x[1]][0]) for x in index.search(decontaminate.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))}
    assert got <= expected and len(expected) > 700
    assert len(got) >= 0.98 * len(expected), len(got) / len(expected)


def test_items_that_share_a_body():
    """4,000 items with four fifths in common and 1,000 texts that hold the common part."""
    some = lambda n, i: " ".join(f"u{i}x{j}" for j in range(n))
    body = some(80, 1)
    began = time.time()
    index = decontaminate.Index([([i], f"{body} {some(20, 100 + i)}") for i in range(4_000)], 5, 75, decontaminate.RADIUS)
    texts = [f"{some(30, 9_000 + i)} {body} {some(30, 20_000 + i) if i % 10 else some(20, 100 + i)}".encode() for i in range(1_000)]
    words_ = decontaminate.Words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    found = index.search(words_)
    assert {(t, i) for t, i, *_ in found} == {(i, i) for i in range(0, 1_000, 10)} and time.time() - began < 30
