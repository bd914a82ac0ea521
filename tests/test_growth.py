"""What larger tables bring out: order of files, ties in time, memory and meetings that grow."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom import registry
from corpusloom.batches import pieces
from corpusloom.functions.text import ngrams
from corpusloom.operators import curation, retrieval
from corpusloom.operators.chunking import packed
from corpusloom.operators.retrieval import _held
from corpusloom.plans.standins import papers
from corpusloom.sources import paged
from corpusloom.streaming import events as s
from corpusloom.streaming.state import _Calls, _Pool
from tests.compare import connect, rows


def test_a_shard_is_served_in_order(spark, tmp_path):
    n = 39 - F.col("id")
    held = spark.range(40).select(F.concat(F.lit("q"), (n % 1).cast("string")).alias("query"), (2000 + n % 1).cast("int").alias("year"), n.alias("n"), F.concat(F.lit("f"), (n % 2).cast("string")).alias("field"))
    fetch = paged.serve(held, str(tmp_path / "served"), "n", "field")
    assert [n for n, _ in fetch(paged.Page("q0", 2000, None, 10, 20))] == list(range(10, 30))
    assert [n for n, _ in fetch(paged.Page("q0", 2000, "f1", 5, 100))] == list(range(11, 40, 2))
    assert fetch(paged.Page("q0", 2001, None, 0, 10)) == []


def same_as_sql(spark, folder, name):
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    return rows(registry.queries()[name](spark, folder).toPandas()), rows(con.execute(registry.oracle_sql()[name]).df())


def test_tasks_with_ties_in_time_and_at_the_end(spark, tmp_path):
    """Events of one time that begin a task; a task that the stream's last event closes; timers at
    the watermark and a millisecond before it."""
    start = datetime(2024, 1, 1)
    end = timedelta(hours=12)
    timer = end - timedelta(minutes=10) - timedelta(hours=2)
    at = [(1, timedelta(0), 4), (1, timedelta(hours=3), 5), (2, timedelta(hours=1), 1), (2, end - timedelta(hours=2, minutes=1), 1), (2, end, 1), (3, timer - timedelta(milliseconds=1), 1), (4, timer - timedelta(milliseconds=2), 1)]
    events = [(user, start + ts, "view", 1.0) for user, ts, n in at for _ in range(n)]
    frame = spark.createDataFrame([(len(events) - i, *e) for i, e in enumerate(events)], "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    got, want = same_as_sql(spark, str(tmp_path), "stream_tasks")
    assert got == want and len(got[1]) == 5


def test_pieces_are_whole_and_bounded():
    texts = ["ab", None, "", "c" * 50, "d", "é" * 4, "e"] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([None if t is None else list(t) for t in texts], pa.list_(pa.string()))], names=["i", "t", "l"])
    for column, of in (("t", lambda x: len((x or "").encode())), ("l", lambda x: len(x or ()))):
        found = list(pieces(batch, column, 10))
        assert pa.Table.from_batches(found).to_pylist() == batch.to_pylist() and len(found) > 9
        assert all(p.num_rows == 1 or sum(map(of, p.column(column).to_pylist())) <= 10 for p in found)
    assert list(pieces(batch.slice(0, 0), "t")) == [] and len(list(pieces(batch.slice(1, 2), "t"))) == 1


def test_chunks_leave_a_task_in_pieces(spark):
    """However many texts come in one batch of Arrow."""
    sizes = lambda held: [b.num_rows for b in held]
    seen = []

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            texts = pa.array(["word " * 2_000] * 1_000)
            seen.extend(sizes(run(iter([pa.RecordBatch.from_arrays([pa.array(range(1_000)), texts], names=["doc_id", "text"])]))))
            return self

    packed(Docs())
    assert sum(seen) == 1_000 and max(seen) < 200


def test_words_of_documents_are_looked_up_in_pieces():
    """However many documents come in one batch of Arrow."""
    out = []

    class Docs:
        def mapInArrow(self, run, _):  # noqa: N802
            words = pa.array([[i % 7, 3, i % 5] * 1_000 for i in range(1_000)], pa.list_(pa.int64()))
            out.extend(run(iter([pa.RecordBatch.from_arrays([pa.array(range(1_000)), words], names=["doc_id", "h"])])))

    class Known:
        value = np.array([2, 3, 9])

    _held(Docs(), Known(), "doc_id")
    assert max(b.num_rows for b in out) < 500
    for r in pa.Table.from_batches(out).to_pylist():
        words = [r["doc_id"] % 7, 3, r["doc_id"] % 5]
        assert r["dl"] == 3_000 and dict(zip(r["term"], r["tf"], strict=True)) == {at: 1_000 * words.count(w) for at, w in enumerate([2, 3, 9]) if w in words}


def test_a_pool_is_read_and_written_once_a_batch():
    """However many papers and turns a session has: every call to the store is a message."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.rows = name, []

        def __getattr__(self, call):
            def called(*rows):
                calls.append((self.name, call))
                if call in ("put", "update"):
                    self.rows = list(rows[0])
                return self.rows if call == "get" else bool(self.rows)

            return called

    class Handle:
        getListState = getValueState = lambda self, name, *_: State(name)
        deleteTimer = registerTimer = lambda self, at: None

    class Times:
        getCurrentWatermarkInMs = lambda self: 0

    pool = _Pool(1_000)
    pool.init(Handle())
    turns = [(i, i, ("found", "read")[i % 2], f"s{i // 2 % 50}", "T", 2000, "p") for i in range(500)]
    frame = pd.DataFrame(turns, columns=["seq", "at_ms", "kind", "source", "title", "year", "preview"])
    for _ in range(2):
        (out,) = pool.handleInputRows((1,), iter([frame]), Times())
    assert calls.count(("papers", "get")) == calls.count(("papers", "put")) + 1 == 2  # the second batch changes nothing
    assert len(pool.papers.rows) == 50 and all(r[4] for r in pool.papers.rows) and len(out) == 0


def test_calls_are_read_and_written_once_a_batch():
    """However many calls and early pieces a stream has: every call to the store is a message."""
    calls = []

    class Held:
        rows = []

        def __getattr__(self, call):
            def called(*rows):
                calls.append(call)
                if call != "get":
                    self.rows = list(rows[0]) if rows else []
                return self.rows

            return called

    class Handle:
        getListState = lambda self, *_: held

    held = Held()
    work = _Calls(None)
    work.init(Handle())
    text = '{"a": "}", "b": [1]}'
    piece = lambda i, n: Row(stream=1, index=i, seq=n, call_id=f"c{i}" if n == 0 else None, name="t" if n == 0 else None, piece=text[2 * n : 2 * n + 2], ended=False)
    late = [piece(i, n) for i in range(40) for n in range(10) if n % 2 == 0]
    assert list(work.handleInputRows((1,), iter(late), None)) == [] and calls == ["get", "put"] and len(held.rows) == 40 * 5
    out = list(work.handleInputRows((1,), iter([piece(i, n) for i in range(40) for n in range(10) if n % 2]), None))
    assert calls == ["get", "put"] * 2 and [(r["index"], r.call_id, r.arguments, r.complete) for r in out] == [(i, f"c{i}", '{"a":"}","b":[1]}', True) for i in range(40)]
    assert len(held.rows) == 40 and not any(r[5] for r in held.rows)


def test_a_batch_is_written_by_several_tasks(spark, tmp_path):
    """And still holds its part alone, also where a part has few rows or none."""
    rows_ = spark.range(5_000).select("id", F.when(F.col("id") < 3_000, 0).when(F.col("id") < 3_002, 1).otherwise(3).alias("part"))
    told = s.drained(s.in_batches(rows_, F.col("part"), 4, str(tmp_path / "in")), "append", str(tmp_path / "out"))
    assert {(r.part, r._batch): r["count"] for r in told.groupBy("part", "_batch").count().collect()} == {(0, 0): 3_000, (1, 1): 2, (3, 3): 1_998}
    files = [f for f in (tmp_path / "in" / "in").iterdir() if f.name.startswith("part-")]
    assert len(files) == 4 * spark.sparkContext.defaultParallelism


def test_users_of_a_block_share_a_state():
    """One call and one row of state for all users of a block; of those with events one row each,
    users without a number among them."""

    class State:
        exists, get, updates = False, None, 0

        def update(self, value):
            self.exists, self.get, self.updates = True, value, self.updates + 1

    state, run = State(), s._in_blocks(s._fold, (0, 0, 0.0, False, ""), lambda x: tuple(x), ["user_id", "n", "resets", "kept", "open", "last"])
    big = 2**60
    frame = lambda users, kinds, at: pd.DataFrame({"user_id": users, "event_id": range(len(users)), "event_type": kinds, "value": 1.5, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta([at] * len(users), unit="h")})
    (one,) = run((7,), iter([frame([big + i for i in range(500)], ["signup"] * 500, 1)]), state)
    (two,) = run((7,), iter([frame([big + 3] * 2, ["view", "purchase"], 3), frame([big + 4] * 2 + [big + 3], ["view"] * 3, 2)]), state)
    assert len(one) == 500 and state.updates == 2 and len(state.get[0]) == 500
    assert {r.user_id: tuple(r)[2:] for r in two.itertuples()} == {big + 3: (4, 1, 0.0, True, "purchase"), big + 4: (3, 0, 3.0, True, "view")}
    (none,) = run((-1,), iter([frame([None] * 2, ["signup", "view"], 1)]), State())
    assert len(none) == 1 and none.user_id.isna().all() and none.n[0] == 2 and none.kept[0] == 1.5


def test_titles_of_frequent_grams_meet_seldom(spark, monkeypatch):
    """And none that are alike are missed, also where every crowd is split again."""
    rng = np.random.default_rng(3)
    titles = ["".join(rng.choice(list("abcdef"), int(rng.integers(3, 70)))) for _ in range(700)]
    for t in list(titles):
        for at in rng.integers(0, len(t), int(rng.integers(1, 4))):
            t = t[:at] + "abcdefg"[int(rng.integers(0, 7))] + t[at + int(rng.integers(0, 2)) :]
        titles.append(t)
    titles = sorted(set(titles))
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in titles]
    want = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and y and 100 * len(x & y) >= 85 * len(x | y)}
    frame = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    for most in (64, 1):
        monkeypatch.setattr(curation, "_MEET", most)
        assert {(r.a, r.b) for r in curation.title_pairs(frame, "id", "t").collect()} == want
    assert len(want) > 50
    grams = frame.select(F.col("id").alias("rep"), F.transform(ngrams(F.col("t"), 3), lambda g: F.xxhash64(g)).alias("g")).where("size(g) > 20").withColumn("m", F.size("g"))
    counts = [r["count"] for r in curation._meetings(grams.withColumns({f"b{i}": F.lit(0).cast("long") for i in range(4)}), 85).groupBy("key").count().collect()]
    n = grams.count()
    assert sum(c * (c - 1) // 2 for c in counts) < 0.02 * n * (n - 1) / 2


def near_titles(seed=5, n=260):
    """Titles with a long beginning in common, so that most parts are shared by chance; some are alike."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 7))))
    base = " ".join(word() for _ in range(14))[:60]
    tails = [" ".join(word() for _ in range(4)) for _ in range(n)]
    tails += [t[: int(rng.integers(1, 8))] for t in tails[:40]] + [t + "x" for t in tails[:40]]
    titles = sorted({f"{base} {t}"[: int(rng.integers(62, 81))].strip() for t in tails})
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in titles]
    return titles, {(i, j): len(x & y) / len(x | y) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if 100 * len(x & y) >= 85 * len(x | y)}


def test_crowds_of_titles_meet_in_blocks(spark, monkeypatch):
    """No key stands for more than two blocks of titles, and pairs are the same."""
    monkeypatch.setattr(curation, "_BLOCK", 30)
    titles, want = near_titles()
    frame = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    assert {(r.a, r.b): r.similarity for r in curation.title_pairs(frame, "id", "t").collect()} == want and len(want) > 100
    grams = frame.select(F.col("id").alias("rep"), F.transform(ngrams(F.col("t"), 3), lambda g: F.xxhash64(g)).alias("g"))
    crowds = curation._crowds(grams, 85)
    before = curation._meetings(grams, 85).groupBy("key").count().agg(F.max("count")).first()[0]
    after = curation._meetings(grams, 85, crowds).groupBy("key").count().agg(F.max("count")).first()[0]
    assert min(crowds.values()) > 30 and before > 150 and after < 3 * 30


def met_on_the_driver(titles, sizes=(7, 100)):
    """What tasks do with titles (rep, t) that meet, however batches cut them: pairs and their similarity."""
    grams, at = curation._gram_sets(pa.array(titles), 3)
    sets = pa.RecordBatch.from_arrays([pa.array(range(len(titles))), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))], names=["rep", "g"])
    rows_ = [(int(k), int(r), titles[r], int(at[r + 1] - at[r]), int(a)) for _, row, keys, ats in curation._split(iter([sets]), 85) for r, k, a in zip(row, keys.view(np.int64), ats, strict=True)]
    met = pa.table([pa.array(x) for x in zip(*sorted(rows_), strict=True)], names=["key", "rep", "t", "m", "at"])
    for size in sizes:
        for held in curation._by_key(iter(met.to_batches(size)), "key"):
            for found in curation._Meeting(held, 85, 3, curation._classes(85)).pairs():
                yield size, *found


@pytest.mark.parametrize("most", [64, 1])
def test_a_pair_is_compared_in_one_part(monkeypatch, most):
    """As a matrix or one title after the other, and pairs leave a task as soon as there are some."""
    monkeypatch.setattr(curation, "_MEET", most)
    monkeypatch.setattr(curation, "_PAIRS", 50)
    titles, want = near_titles()
    found = [(size, int(x), int(y), s) for size, a, b, similarity in met_on_the_driver(titles) for x, y, s in zip(a, b, similarity, strict=True)]
    assert len(found) == 2 * len(want) and all({(x, y): s for at, x, y, s in found if at == size} == want for size in (7, 100))


def test_titles_are_joined_by_few_pairs(spark):
    """However many are alike: links grow with the titles, and tell how many pairs there are."""
    base = "".join(np.random.default_rng(4).choice(list("abcdefghij"), 78))
    titles = [base[:i] + x + base[i + 1 :] for i in (0, 1, 76, 77) for x in "klmnopqrstuvwxyz"]
    same = spark.createDataFrame(list(enumerate(titles)), "rep long, t string")
    links = curation._similar_titles(same, 85, 3, linked=True).collect()
    assert sum(r.n for r in links) == curation._similar_titles(same, 85, 3).count() == len(titles) * (len(titles) - 1) // 2
    a, b, n = curation._stars(np.repeat(np.arange(300), 300), np.tile(np.arange(300), 300))
    assert (a, b, sum(n)) == ([0] * 299, list(range(1, 300)), 90_000)
    found = curation._stars(np.array([5, 7, 9, 2, 5]), np.array([7, 8, 4, 9, 8]))
    assert sorted(zip(*found[:2], strict=True)) == [(2, 4), (2, 9), (5, 7), (5, 8)] and sorted(found[2]) == [0, 0, 2, 3]


@pytest.mark.parametrize("size", [3, 1_000])
def test_titles_replayed_are_compared_with_the_kept_ones(size):
    """Components one after the other, in batches of any size, with places that change their title."""
    rng = np.random.default_rng(9)
    rows_, want = [], set()
    for component in (1, 4, 5):
        base = "".join(rng.choice(list("abcdefghijklmnop"), 120))
        titles = sorted({base[i : i + 60] for i in range(0, 60, 2)} | {base[i : i + 62] for i in range(0, 50, 7)})
        sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in titles]
        kept = []
        for _ in range(150):
            x, c, i = int(rng.integers(0, len(titles))), int(rng.integers(0, 30)), len(rows_)
            rows_.append((component, i, c, component * 100 + x, titles[x]))
            at = next((k for k, (_, y, _) in enumerate(kept) if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])), None)
            if at is None:
                kept.append((i, x, c))
            elif c > kept[at][2]:
                kept[at] = (i, x, c)
        want |= {i for i, *_ in kept}
    told = pa.table([pa.array(x) for x in zip(*rows_, strict=True)], names=["component", "id", "c", "rep", "t"])
    found = [i for out in curation._replayed(iter(told.to_batches(size)), 85, 3) for i in out.column(0).to_pylist()]
    assert sorted(found) == sorted(want) and 12 < len(want) < 60


def test_whole_texts_are_sent_for_no_title(spark, sf_dir):
    """Where labels are too many for every task, records meet them by a shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows_ = papers(spark, sf_dir).select("doc_id", "title", "tier")
        sent = rows_._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].splitlines()[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Project" in sent and "substring(text" in sent
    assert papers(spark, sf_dir).columns == ["doc_id", "text", "lang", "source", "n_chars", "title", "journal_rank", "citations", "year", "tier", "doi", "publisher_doi", "venue"]


@pytest.mark.parametrize("name", ["highlight_passages", "idf_overlap_top3"])
@pytest.mark.parametrize("frequent", [1 << 21, 40, 0])
def test_passages_by_sql_however_few_words_take_weights_along(spark, tmp_path, monkeypatch, name, frequent):
    """Words with and without weights in tasks, one that every passage has, rows of one doc_id,
    copies, texts without words; chunks of several blocks, and some with words of no passage."""
    monkeypatch.setattr(retrieval, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(retrieval, "TEXT_QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 150)
    monkeypatch.setattr(retrieval, "_OVERLAPS", 50)
    rng = np.random.default_rng(1)
    line = lambda n: " ".join(["every", *(f"Word{int(w)}" for w in rng.zipf(1.3, n) % 3000)])
    texts = ["\n".join(line(rng.integers(8, 40)) for _ in range(rng.integers(1, 5))) for _ in range(150)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs += [(i, texts[i // 2], "en", "s", 1) for i in range(0, 60, 3)] + [(900, None, "en", "s", 0), (901, "- " * 60, "en", "s", 120)] + [(1000 + i, texts[7], "en", "s", 1) for i in range(9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(i, line(12) + f" none{i}") for i in range(20)] + [(20, "every"), (21, "nothing of it"), (22, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = connect("/root/testdata/sf0.001")
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got, want = rows(registry.queries()[name](spark, str(tmp_path)).toPandas()), rows(con.execute(registry.oracle_sql()[name]).df())
    assert got == want and len(got[1]) > 55


def test_only_rare_words_are_sent_to_their_weights(spark):
    idf = spark.createDataFrame([(h, level, float(h)) for h, level in ((5, 3), (-7, 3), (9, 2), (2, 2), (4, 1), (-1, 1))], "h long, level int, idf double")
    base = spark.createDataFrame([(1, [5, 9, 4]), (2, [-7, 2]), (3, [-1]), (4, [])], "k long, h array<long>")
    for most, sent in ((6, [[], []]), (4, [[], []]), (2, [[9, 4], [2]])):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(retrieval, "FREQUENT_WORDS", most)
            frequent, rare, single = retrieval._by_frequency(idf.where("h != -1"))
        assert (rare is None) == (most > 2)
        found = retrieval._weighed(base.coalesce(1), spark.sparkContext.broadcast((*frequent, np.array([-7, 5]), single)), "k").collect()
        assert [(r["k"], r["term"], r["rest"]) for r in found] == [(1, [1], sent[0]), (2, [0], sent[1])]
        assert [r["total"] for r in found] == ([18.0, -5.0] if most > 2 else [5.0, -7.0])


def test_overlaps_are_those_of_all_sums(monkeypatch):
    """As a dense product gives them, in work by the words that documents hold."""
    monkeypatch.setattr(retrieval, "_OVERLAPS", 200)
    rng = np.random.default_rng(2)
    docs, chunks, terms = 300, 11, 90
    there, held = rng.random((docs, terms)) < 0.1, rng.random((terms, chunks)) < 0.2
    there[::7] = False
    idf, total = rng.normal(1, 1, terms), rng.normal(40, 10, docs)
    term, of = np.nonzero(held)
    block = retrieval._Overlaps(of, term, idf, chunks, 4)
    for lo in range(0, docs, 64):
        row, which = np.nonzero(there[lo : lo + 64])
        block.add(row, which, total[lo : lo + 64], np.arange(lo, min(docs, lo + 64)))
    both = (there * idf) @ held
    scores = np.round(0.5 * both / (total[:, None] + idf @ held - both) + 0.5 * (there.astype(int) @ held) / held.sum(axis=0), 9)
    scores[there.astype(int) @ held == 0] = -np.inf
    assert np.array_equal(block.best.keys, np.argsort(-scores, axis=0, kind="stable")[:4].T)


def test_hashes_are_looked_up():
    rng = np.random.default_rng(3)
    least, most = -(1 << 63), (1 << 63) - 1
    for names in (rng.integers(least, most, 5000), np.array([0]), np.array([least, -1, 0, 1, most]), np.arange(-2000, 2000) * 3):
        names = np.unique(names)
        look = retrieval._lookup(names)
        assert np.array_equal(look(names[::-1]), np.arange(len(names))[::-1])
        other = np.setdiff1d(np.concatenate([rng.integers(least, most, 500), np.arange(-90, 90), [least, most]]), names)
        assert not np.isin(names[look(other)], other).any()
