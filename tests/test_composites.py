"""Verbs and streams that SQL can't express, against plain Python."""

from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom import registry
from corpusloom.operators import chunking, composites
from corpusloom.plans.standins import papers
from corpusloom.streaming import events as s


def test_curation_keeps_one_of_each(spark, sf_dir):
    rows = composites.curate(papers(spark, sf_dir)).collect()
    dois = [r.doi for r in rows if r.doi]
    assert len(dois) == len(set(dois)) and [r.citations for r in rows] == sorted((r.citations for r in rows), reverse=True)


def test_update_twice_is_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = composites.update(chunking.fixed(docs.limit(50)), docs.limit(70), chunking.fixed)
    two = composites.update(one, docs.limit(70), chunking.fixed)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_search_filters_and_variants(spark, sf_dir):
    docs = papers(spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = vectors.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.lit("the stability of it in a tandem").alias("query_text"), F.col("embedding").alias("query_vector"))
    some = {r.source for r in docs.where("year between 2015 and 2016").select("source").collect()}
    got = composites.search(docs, vectors, queries, 5, year_min=2015, year_max=2016).collect()
    assert got and {r.source for r in got} <= some and max(r["rank"] for r in got) == 5 and {r.query_id for r in got} == {0, 1, 2}


def test_agent_states(spark, sf_dir):
    got = {r.user_id: (r.state, r.calls, r.failed, r.loops) for r in registry.queries()["stream_agent_states"](spark, sf_dir).collect()}
    by = defaultdict(list)
    for e in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").collect():
        by[e.user_id].append(e.event_type)
    for user, kinds in by.items():
        assert got[user] == by_hand(kinds)


def by_hand(kinds):
    """State, calls, errors and states entered, one event after the other."""
    state, entered, left, calls, failed = "retrieve", 1, 2, 0, 0
    follows, may = {"retrieve": "quick_read", "quick_read": "deep_read", "deep_read": "respond"}, {"retrieve": 2, "quick_read": 3, "deep_read": 4, "respond": 0}
    for kind in kinds:
        if state == "respond":
            break
        calls, left, failed = calls + 1, left - 1, failed + (kind == "error")
        new = "respond" if calls == 15 or kind == "purchase" else "retrieve" if kind == "signup" and state != "retrieve" else follows[state] if not left else None
        if new:
            entered += 1
            state = new if entered <= 8 else "respond"
            left = may[state]
    return state, calls, failed, entered


def test_limits_of_an_agent(spark, tmp_path):
    """Eight states and fifteen calls at most, over batches that end anywhere."""
    turning = ["view", "view", "signup"] * 9
    slow = ["view", "view", "error", "signup"] * 9
    cases = {1: turning, 2: slow, 3: ["view"] * 40, 4: ["signup"] * 20, 5: ["view", "purchase", "view"]}
    rows = [(u, i, k, f"2024-01-01 10:{i:02d}:00") for u, kinds in cases.items() for i, k in enumerate(kinds)]
    frame = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    stream = s.in_batches(frame, F.floor(F.col("event_id") / 5), 8, str(tmp_path / "in"))
    got = s.latest(s.drained(s.agent_states(stream), "update", str(tmp_path / "out")), "user_id").collect()
    assert {r.user_id: (r.state, r.calls, r.failed, r.loops) for r in got} == {u: by_hand(k) for u, k in cases.items()}
    assert {r.user_id: (r.calls, r.loops) for r in got}[1][1] == 9 and max(r.calls for r in got) <= 15


def test_late_and_repeated_events(spark, tmp_path):
    """Events that come in twice, and after the watermark, in three files."""
    rows = [[(1, 1, "view", 1.0, "2024-01-01 10:00:00"), (1, 2, "view", 1.0, "2024-01-01 10:05:00")], [(1, 2, "view", 1.0, "2024-01-01 10:05:00"), (1, 3, "view", 1.0, "2024-01-01 12:30:00")], [(1, 4, "view", 1.0, "2024-01-01 09:00:00"), (1, 5, "view", 1.0, "2024-01-01 15:00:00")]]
    schema = "user_id long, event_id long, event_type string, value double, ts string"
    for i, part in enumerate(rows):
        frame = spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not i:
            read = frame.schema
    stream = spark.readStream.schema(read).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = s.drained(s.tumbling(stream), "append", str(tmp_path / "out")).collect()
    assert {(str(r.window_start)[11:13], r.n) for r in out} <= {("10", 3), ("12", 1), ("09", 1)} and ("10", 3) in {(str(r.window_start)[11:13], r.n) for r in out}
    once = s.drained(s.deduplicated(stream, "event_id"), "append", str(tmp_path / "once"))
    assert sorted(r.event_id for r in once.collect())[:3] == [1, 2, 3]
    last = s.upserted(stream.select("user_id", "event_id", "value"), "user_id", "event_id", str(tmp_path / "up")).collect()
    assert [(r.user_id, r.event_id) for r in last] == [(1, 5)]


def test_last_place_takes_the_next_of_any_journal(spark):
    import random

    from corpusloom.operators.ranking import diverse

    rng = random.Random(3)
    groups = {0: "AAAAAABCAD"} | {g: "".join(rng.choices("ABCDEFGH", [12, 2, 1, 1, 1, 1, 1, 1], k=rng.randint(1, 40))) for g in range(1, 80)}
    pool = spark.createDataFrame([(g, i, j, float(-i)) for g, js in groups.items() for i, j in enumerate(js)], "g long, id long, journal string, score double")
    for n in (1, 4):
        wanted = set()
        for g, js in groups.items():
            chosen = []
            for i, j in enumerate(js):
                if len(chosen) < n and (len(chosen) >= n - 1 or j not in {js[c] for c in chosen}):
                    chosen.append(i)
            wanted |= {(g, i, place) for place, i in enumerate(chosen, 1)}
        assert {tuple(r) for r in diverse(pool, "g", n).collect()} == wanted
