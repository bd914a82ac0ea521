"""Logs with offsets, tool calls from pieces, pools of sessions: restarts, splits, ends."""

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import events as s
from corpusloom.streaming import log
from corpusloom.streaming import state as st

EVENTS = "event_id long, name string"


@pytest.fixture
def told(spark, tmp_path):
    """A function that tells events to a log in a stream of two files a batch."""
    spark.dataSource.register(log.EventLog)
    at = str(tmp_path)

    def tell(ids):
        spark.createDataFrame([(i, f"e{i}") for i in ids], EVENTS).repartition(3).write.mode("append").parquet(f"{at}/in")
        run()

    def run():
        files = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
        files.writeStream.format("event_log").option("path", f"{at}/log").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()

    def read(name, start=0):
        rows = spark.readStream.format("event_log").option("path", f"{at}/log").option("events", EVENTS).option("from", start).load()
        return sorted((r.offset, r.event_id, r.name) for r in s.drained(rows, "append", f"{at}/{name}").collect())

    tell.run, tell.read, tell.at = run, read, tmp_path
    return tell


def test_a_reader_goes_on_where_it_was(told):
    assert told.read("none") == []
    told(range(50))
    first = told.read("one")
    assert [o for o, *_ in first] == list(range(50)) and sorted(i for _, i, _ in first) == list(range(50)) and all(n == f"e{i}" for _, i, n in first)
    told(range(50, 90))
    assert told.read("one")[:50] == first and sorted(i for _, i, _ in told.read("one")) == list(range(90))
    whole = told.read("two")
    for start in (0, 13, 50, 77, 90, 200):
        assert told.read(f"from{start}", start) == whole[start:]


def test_a_killed_run_tells_nothing_twice(told):
    """The sink had committed its batch, but the query died before it knew: it runs it again."""
    told(range(60))
    before = told.read("one")
    last = max((told.at / "progress" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    files = set((told.at / "log" / "events").iterdir())
    told.run()
    assert told.read("two") == before and set((told.at / "log" / "events").iterdir()) == files
    told(range(60, 70))
    assert sorted(i for _, i, _ in told.read("two")) == list(range(70))


def test_a_batch_without_manifest_is_not_there(told):
    """Files of a batch that was never committed are not read; an aborted one leaves none."""
    told(range(10))
    whole = told.read("one")
    writer = log._Writer(str(told.at / "log"), log.StructType.fromDDL(EVENTS))
    import pyarrow as pa

    wrote = writer.write(iter([pa.RecordBatch.from_pydict({"event_id": [99], "name": ["lost"]})]))
    assert told.read("two") == whole
    writer.abort([wrote, None], 77)
    assert not (told.at / "log" / wrote.name).exists()


PIECES = "stream long, index int, seq int, call_id string, name string, piece string, ended boolean"


def calls(spark, rows, part, n, folder):
    with st.stateful(spark):
        stream = s.in_batches(spark.createDataFrame(rows, PIECES), part, n, folder)
        out = s.drained(st.tool_calls(stream, None), "append", f"{folder}/out").drop("_batch").collect()
    return sorted(map(tuple, out))


def test_pieces_over_batches_give_the_same_calls(spark, tmp_path):
    made = []
    for stream in range(6):
        for index in range(4):
            held = {"q": f'a "{stream}" \\ {{[', "n": [index, {"deep": None}], "é": "漢"}
            text = json.dumps(held, ensure_ascii=index % 2 == 0) + (" trailing" if index == 3 else "")
            size = 1 + (stream + index) % 5
            for seq in range(0, -(-len(text) // size)):
                made.append((stream, index, seq, f"c{index}" if seq == 1 else None, f"tool{index}" if seq == 0 else "", text[seq * size : (seq + 1) * size], False))
    made += [(0, 9, 0, "x", "cut", '{"a": 1', False), (1, 9, 0, "x", "bad", '{"a" 1}', False), (2, 9, 0, "x", "", "{}", False), (3, 9, 0, "x", "list", "[1]", False), (4, 9, 1, "x", "gap", "}", False)]
    made += made[:7] + [(i, None, None, None, None, None, True) for i in range(6)] + [(None, 0, 0, "x", "none", "{}", False)]
    want = sorted((i, j, f"c{j}", f"tool{j}", json.dumps({"q": f'a "{i}" \\ {{[', "n": [j, {"deep": None}], "é": "漢"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False), True) for i in range(6) for j in range(4))
    want = sorted([*want, (0, 9, "x", "cut", "{}", False), (1, 9, "x", "bad", "{}", False), (3, 9, "x", "list", "{}", False)])
    end = F.when(F.col("ended"), 3)
    one = calls(spark, made, F.lit(0), 1, str(tmp_path / "one"))
    split = calls(spark, made, end.otherwise(F.coalesce(F.col("seq"), F.lit(0)) * 2 % 3), 4, str(tmp_path / "split"))
    assert split == one == want


def test_pieces_without_news_are_forgotten(spark, tmp_path):
    """With a time to live the query goes on by itself; what was open is gone after it."""
    folder = str(tmp_path)
    first = spark.createDataFrame([(1, 0, 0, "c", "tool", '{"a":', False)], PIECES)
    rest = spark.createDataFrame([(1, 0, 1, None, None, "1}", False), (2, 0, 0, "d", "tool", "{}", False)], PIECES)
    first.coalesce(1).write.parquet(f"{folder}/in")
    with st.stateful(spark):
        stream = spark.readStream.schema(PIECES).parquet(f"{folder}/in")
        query = st.tool_calls(stream, 1_000).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", f"{folder}/p").start()
        try:
            until = time.time() + 60
            while time.time() < until and not any(p.get("numInputRows") for p in query.recentProgress):
                time.sleep(0.2)
            time.sleep(3)
            rest.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            while time.time() < until and not spark.table("forgotten").count():
                time.sleep(0.5)
        finally:
            query.stop()
    assert [tuple(r) for r in spark.table("forgotten").collect()] == [(2, 0, "d", "tool", "{}", True)]


TURNS = "session_id long, seq long, at timestamp, kind string, source string, title string, year int, preview string"


def turn(session, seq, kind, source="", title="", year=None, preview="", minutes=0):
    return session, seq, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes or seq), kind, source, title, year, preview


def pools(spark, folder, turns, pool=None, **more):
    spark.createDataFrame(turns, TURNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    with st.stateful(spark):
        stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        rows = s.drained(st.session_pool(stream, pool, **more), "update", f"{folder}/out").collect()
    held = {}
    for r in sorted(rows, key=lambda r: r._batch):
        held[r.session_id, r.source] = None if r.dropped else (r.title, r.year, r.preview, r.is_read, r.has_fulltext)
    return {k: v for k, v in held.items() if v}


def test_a_pool_survives_a_restart_and_ends(spark, tmp_path):
    folder = str(tmp_path)
    pool = spark.createDataFrame([(1, "old", "", None, "kept", False, True), (3, "other", "T", 1999, "", True, False)], f"session_id long, source string, {st._RECORD}")
    got = pools(spark, folder, [turn(1, 1, "found", "a", preview="x" * 900), turn(1, 2, "found", "old", "Title"), turn(1, 3, "read", "never seen"), turn(2, 4, "found", "b", "B", 2001), turn(2, 5, "found", "")], pool)
    assert got == {(1, "a"): ("", None, "x" * 500, False, True), (1, "old"): ("Title", None, "kept", False, True), (2, "b"): ("B", 2001, "", False, True)}
    got = pools(spark, folder, [turn(1, 11, "found", "a", "A", 2005, "later"), turn(1, 12, "read", "a"), turn(1, 13, "found", "old", "Other", 2010), turn(2, 14, "no_text", "b"), turn(3, 15, "read", "other")], pool)
    assert got == {(1, "a"): ("A", 2005, "x" * 500, True, True), (1, "old"): ("Title", 2010, "kept", False, True), (2, "b"): ("B", 2001, "", True, False), (3, "other"): ("T", 1999, "", True, True)}
    got = pools(spark, folder, [turn(1, 21, "end"), turn(1, 22, "found", "a", "anew"), turn(2, 23, "found", "c"), turn(2, 24, "end")], pool)
    assert got == {(1, "a"): ("anew", None, "", False, True), (3, "other"): ("T", 1999, "", True, True)}


def test_an_idle_pool_is_dropped(spark, tmp_path):
    folder, more = str(tmp_path), {"idle_ms": 3_600_000, "delay": "1 minute"}
    assert set(pools(spark, folder, [turn(1, 1, "found", "a"), turn(2, 2, "found", "b")], **more)) == {(1, "a"), (2, "b")}
    assert set(pools(spark, folder, [turn(2, 3, "found", "c", minutes=50)], **more)) == {(1, "a"), (2, "b"), (2, "c")}
    assert set(pools(spark, folder, [turn(4, 9, "found", "z", minutes=70)], **more)) == {(2, "b"), (2, "c"), (4, "z")}
