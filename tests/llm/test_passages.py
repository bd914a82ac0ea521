"""Passages against ones planted, and all pairs of words."""

import time
from difflib import SequenceMatcher

import numpy as np
import pytest

from corpusloom.llm import passages
from corpusloom.llm.registry import op2_collinear_passages

from .conftest import words


def test_passages_are_found(make):
    common = words(60, 20).split()
    fuzzy = [*common[:25], "zz", *common[26:45], *common[46:]]
    docs = make([(1, words(200, 1) + " " + " ".join(common) + " " + words(90, 2)), (2, words(150, 3) + " " + " ".join(common).upper()), (3, " ".join(fuzzy) + " " + words(400, 4)), (4, words(500, 5)), (5, " ".join(common[:30]) + " " + words(300, 6))])
    found = passages.repeated_passages(docs, least_words=50).collect()
    assert {(r.doc_id, r.partner) for r in found} == {(2, 1), (3, 1)}
    exact = next(r for r in found if r.doc_id == 2)
    assert (exact.start_word, exact.end_word, exact.partner_start, exact.identity) == (150, 210, 200, 1.0)
    loose = next(r for r in found if r.doc_id == 3)
    assert loose.start_word == 0 and loose.end_word == 59 and 0.9 < loose.identity < 1


def test_chains_are_the_best():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        x, y = rng.integers(0, 60, n), rng.integers(0, 60, n)

        def best(i):
            before = [best(j) - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(n) if x[j] < x[i] and y[j] < y[i]]
            return passages.SEED_WORDS + max([0, *before])

        top = passages.chains(x, y)[0]
        score = len(top) * passages.SEED_WORDS - passages.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(top, top[1:], strict=False))
        assert score == pytest.approx(max(best(i) for i in range(n)))


def test_every_place_of_a_passage_is_found(make):
    rng = np.random.default_rng(11)
    some = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**9, n))
    common, own = some(60), some(70)
    docs = make([(1, " ".join([common, some(100), common, some(90), common])), (2, " ".join([some(30), common, some(80), common])), (3, " ".join([some(20), own, some(200), own])), (4, some(400))])
    found = {(r.doc_id, r.start_word, r.end_word, r.partner, r.partner_start) for r in passages.repeated_passages(docs).collect()}
    assert found == {(1, 160, 220, 1, 0), (1, 310, 370, 1, 0), (2, 30, 90, 1, 0), (2, 170, 230, 1, 0), (3, 290, 360, 3, 20)}
    across = {(r.doc_id, r.start_word, r.end_word, r.partner, r.partner_start) for r in passages.repeated_passages(docs, within=False).collect()}
    assert across == {(2, 30, 90, 1, 0), (2, 170, 230, 1, 0)}


def test_texts_of_one_id_are_not_mixed(make):
    rng = np.random.default_rng(12)
    a, b = (" ".join(f"v{i}" for i in rng.integers(0, 10**9, n)) for n in (60, 90))
    assert passages.repeated_passages(make([(1, a + " " + b), (1, b + " " + a)])).count() == 0


def test_passages_with_a_change_every_few_words(make):
    rng = np.random.default_rng(13)
    some = lambda n: [f"v{i}" for i in rng.integers(0, 10**9, n)]
    rows, wanted = [], set()
    for i in range(20):
        common = some(60)
        fuzzy = [f"z{i}-{j}" if j % 6 == 5 else w for j, w in enumerate(common)]
        rows += [(i, " ".join(some(50) + common + some(50))), (100 + i, " ".join(some(50) + fuzzy + some(50)))]
        wanted.add((100 + i, i))
    assert {(r.doc_id, r.partner) for r in passages.repeated_passages(make(rows)).collect()} == wanted


def test_passages_are_extended_until_unlike(make):
    """A run of 300 words with 200 on both sides of which every fourth is changed, which
    leaves no seed there but a rising score."""
    rng = np.random.default_rng(14)
    some = lambda n: [f"v{i}" for i in rng.integers(0, 10**9, n)]
    common = some(700)
    fuzzy = [w if 200 <= j < 500 or j % 4 else f"z{j}" for j, w in enumerate(common)]
    got = passages.repeated_passages(make([(1, " ".join(common)), (2, " ".join(some(40) + fuzzy + some(40)))])).collect()
    assert [(r.doc_id, r.partner, r.start_word <= 41, r.end_word >= 739) for r in got] == [(2, 1, True, True)]


def some(rng, n):
    return [f"v{i}" for i in rng.integers(0, 10**9, n)]


@pytest.mark.parametrize("half", [30, 45, 120])
def test_passages_of_parts_that_stand_first_elsewhere(make, half):
    """C and D share a passage whose halves stand first in A and in B."""
    rng, rows = np.random.default_rng(half), []
    for g in range(20):
        one, other = some(rng, half), some(rng, half)
        texts = one, other, one + other, one + other
        rows += [(4 * g + i, " ".join(some(rng, 60) + t + some(rng, 60))) for i, t in enumerate(texts)]
    found = {(r.doc_id, r.partner): r.n_words for r in passages.repeated_passages(make(rows)).collect()}
    assert [found.get((4 * g + 3, 4 * g + 2)) for g in range(20)] == [2 * half] * 20


def test_seeds_of_very_many_places(make, monkeypatch):
    """A passage in every document, dealt out by document, in groups of few bytes."""
    rng = np.random.default_rng(31)
    common, fuzzy, rows = some(rng, 70), some(rng, 80), []
    for i in range(150):
        edited = [f"z{i}-{j}" if j % 9 == 4 else w for j, w in enumerate(fuzzy)]
        rows.append((i, " ".join(some(rng, 40) + common + some(rng, 40) + edited + some(rng, 20))))
    one = sorted(map(tuple, passages.repeated_passages(make(rows)).collect()))
    assert {(d, p) for d, _, _, p, *_ in one} >= {(i, 0) for i in range(1, 150)} and len(one) >= 2 * 149
    for name, value in (("HOT_PLACES", 20), ("PART_BYTES", 20)):
        monkeypatch.setattr(passages, name, value)
    assert sorted(map(tuple, passages.repeated_passages(make(rows)).collect())) == one


def test_recall_against_all_pairs(make):
    """Passages of 50 to 150 words with up to 15 % of the words replaced, left out or put in,
    planted in pairs; what is found has the identity that it says."""
    rng, rows, planted = np.random.default_rng(32), [], []
    for i in range(150):
        n, share = int(rng.integers(50, 150)), float(rng.choice([0, 0.05, 0.1, 0.15]))
        common = some(rng, n)
        other = [w for w in common for w in ([w] if rng.random() >= share else [[f"r{rng.integers(10**9)}"], [], [w, f"p{rng.integers(10**9)}"]][int(rng.integers(0, 3))])]
        lead = int(rng.integers(0, 80))
        rows += [(2 * i, " ".join(some(rng, 30) + common + some(rng, 30))), (2 * i + 1, " ".join(some(rng, lead) + other + some(rng, 30)))]
        blocks = SequenceMatcher(None, common, other, autojunk=False).get_matching_blocks()
        if min(len(common), len(other)) >= 56 and sum(b.size for b in blocks) >= 0.84 * max(len(common), len(other)):
            planted.append((2 * i + 1, 2 * i, lead, len(other)))
    found = {(r.doc_id, r.partner): r for r in passages.repeated_passages(make(rows)).collect()}
    assert all(d == p + 1 for d, p in found)  # nothing but what was planted
    hit = [(d, p) for d, p, lead, n in planted if (d, p) in found and abs(found[d, p].start_word - lead) <= 12 and abs(found[d, p].end_word - lead - n) <= 12]
    assert len(planted) > 80 and len(hit) >= 0.95 * len(planted)
    texts = {d: t.lower().split() for d, t in rows}
    for (d, p), r in found.items():
        one, other = texts[d][r.start_word : r.end_word], texts[p][r.partner_start : r.partner_end]
        same = sum(b.size for b in SequenceMatcher(None, one, other, autojunk=False).get_matching_blocks())
        assert r.identity >= 0.8 and min(len(one), len(other)) >= 50 and abs(same / max(len(one), len(other)) - r.identity) < 0.05


@pytest.mark.parametrize(("n", "share", "least"), [(50, 0.1, 0.9), (50, 0.15, 0.85), (52, 0.15, 0.85), (55, 0.15, 0.9), (60, 0.18, 0.9)])
def test_recall_at_the_shortest(make, n, share, least):
    """Of 100 passages with words replaced inside, the first and the last equal, nearly all are
    found: all that are planted count."""
    rng, rows = np.random.default_rng(n), []
    for i in range(100):
        common = some(rng, n)
        other = list(common)
        for j in rng.choice(np.arange(1, n - 1), int(share * n), replace=False):
            other[j] = f"r{rng.integers(10**9)}"
        rows += [(2 * i, " ".join(some(rng, 40) + common + some(rng, 40))), (2 * i + 1, " ".join(some(rng, 40) + other + some(rng, 40)))]
    found = {(r.doc_id, r.partner) for r in passages.repeated_passages(make(rows)).collect()}
    assert found <= {(2 * i + 1, 2 * i) for i in range(100)}
    assert len(found) >= 100 * least, len(found)


def test_short_runs_are_not_stretched(make):
    """A run of 45 equal words among unlike ones stays short of 50."""
    rng, rows = np.random.default_rng(41), []
    for i in range(20):
        common = some(rng, 45)
        rows += [(2 * i, " ".join(some(rng, 40) + common + some(rng, 40))), (2 * i + 1, " ".join(some(rng, 40) + common + some(rng, 40)))]
    assert passages.repeated_passages(make(rows)).count() == 0


def test_passages_of_the_table(spark, documents, sf_dir):
    """The registered query: every passage found in the given documents is one, and no exact run
    of 60 words that an earlier document, or an earlier place of the same, holds is left out."""
    texts = {r.doc_id: (r.text or "").lower().split() for r in documents.collect()}
    found = op2_collinear_passages(spark, sf_dir).collect()
    assert any(r.doc_id == r.partner for r in found)
    spans: dict = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
        one, other = texts[r.doc_id][r.start_word : r.end_word], texts[r.partner][r.partner_start : r.partner_end]
        assert (r.partner, r.partner_start) < (r.doc_id, r.start_word) and min(len(one), len(other)) >= 50 and r.identity >= 0.8
    first: dict = {}
    missed = tried = 0
    for d in sorted(texts):
        w = texts[d]
        for i in range(0, len(w) - 59):
            run = tuple(w[i : i + 60])
            if first.setdefault(run, (d, i)) != (d, i):
                tried += 1
                missed += not any(a <= i + 5 and i + 55 <= b for a, b in spans.get(d, ()))
    assert tried > 100 and missed <= 0.02 * tried, (missed, tried)


def test_passages_near_each_other_are_told_apart(make):
    """Two passages with 40 unlike words between them, which together are not alike enough."""
    rng = np.random.default_rng(33)
    a, b = some(rng, 60), some(rng, 55)
    got = passages.repeated_passages(make([(i, " ".join(some(rng, 9) + a + some(rng, 40) + b + some(rng, 9))) for i in range(3)])).collect()
    assert sorted((r.doc_id, r.partner, r.start_word, r.end_word, r.identity) for r in got) == [(i, 0, s, e, 1.0) for i in (1, 2) for s, e in ((9, 69), (109, 164))]


def test_a_text_that_repeats_itself_is_not_its_own_copy(make):
    rng = np.random.default_rng(34)
    period = some(rng, 4)
    got = passages.repeated_passages(make([(1, " ".join(some(rng, 20) + period * 60 + some(rng, 20))), (2, " ".join(some(rng, 9) * 40))])).collect()
    assert got and all((r.partner, r.partner_start) < (r.doc_id, r.start_word) for r in got)


def test_words_in_common_by_the_usual_table_and_fast():
    rng = np.random.default_rng(8)
    for _ in range(300):
        one, other = (rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint32) for _ in range(2))
        row = [0] * (len(other) + 1)
        for w in one.tolist():
            new = [0]
            for j, v in enumerate(other.tolist()):
                new.append(row[j] + 1 if v == w else max(row[j + 1], new[j]))
            row = new
        assert passages._common(one, other) == row[-1]
    one = rng.integers(0, 5000, 20_000).astype(np.uint32)
    began = time.thread_time()
    assert passages._common(one, np.delete(one, rng.integers(0, 20_000, 4_000))) > 16_000
    assert time.thread_time() - began < 0.4  # 0.04 s, and 1.3 s with a row of the table for each word


def test_reach_passes_over_the_first_shift_that_fits():
    rng = np.random.default_rng(9)

    def reach(a, b, most):
        p = q = matches = 0
        while True:
            n, same = passages._straight(a[p:], b[q:])
            p, q, matches = p + n, q + n, matches + same
            fits = [
                (i, j)
                for i, j in passages._SHIFTS
                if q + j - p - i <= most and len(run := a[p + i : p + i + passages.RESUME]) == passages.RESUME and np.array_equal(run, b[q + j : q + j + passages.RESUME])
            ]
            if not fits:
                return p, q, matches
            p, q = p + fits[0][0], q + fits[0][1]

    for k in range(500):
        one = rng.integers(0, 2 + k % 30, rng.integers(0, 60)).astype(np.uint32)
        other = np.insert(np.delete(one, rng.integers(0, len(one), 2)), rng.integers(0, len(one) - 2, 1), 99) if len(one) > 3 else one[::-1]
        most = int(rng.integers(0, 4)) if k % 2 else passages._FAR
        assert passages._reach(one, other, most) == reach(one, other, most)
        assert passages._reach(one[::-1], other[::-1], most) == reach(one[::-1], other[::-1], most)
