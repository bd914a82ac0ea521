"""Queries of event streams: each drains a stream over the table of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.registry import query
from corpusloom.session import shared_folder, table
from corpusloom.streaming import events as s
from corpusloom.streaming.log import EventLog
from corpusloom.streaming.state import session_pool, stateful, tool_calls

# A window comes out once the watermark (ten minutes behind the latest event) has passed its end.
_CLOSED = "<= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir):
    """The events in three micro-batches, in order of time: state goes from one to the next."""
    rows = table(spark, sf_dir, "events")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    return s.in_batches(rows, (F.col("ts") > F.lit(first + third)).cast("int") + (F.col("ts") > F.lit(first + 2 * third)).cast("int"), 3, _folder(spark))


def _drained(spark, stream, mode):
    return s.drained(stream, mode, _folder(spark))


def _plain(rows):
    """Times as the table has them, without a zone."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in rows.dtypes if kind == "timestamp"}).drop("_batch")


@query("stream_tumbling", f"SELECT * FROM (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3) WHERE window_end {_CLOSED}")
def stream_tumbling(spark, sf_dir):
    return _plain(_drained(spark, s.tumbling(_stream(spark, sf_dir)), "append"))


@query("stream_sliding", f"SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS window_start FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR FROM events) GROUP BY window_start HAVING window_start + INTERVAL 2 HOUR {_CLOSED}")
def stream_sliding(spark, sf_dir):
    return _plain(_drained(spark, s.sliding(_stream(spark, sf_dir)), "append"))


@query("stream_session", f"""WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE {_CLOSED}""")
def stream_session(spark, sf_dir):
    return _plain(_drained(spark, s.sessions(_stream(spark, sf_dir)), "append"))


@query("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY user_id, event_type")
def stream_dedup(spark, sf_dir):
    """The stream with every event twice; what stays is counted."""
    stream = _stream(spark, sf_dir)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _drained(spark, s.deduplicated(twice, "event_id"), "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_fold", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
p AS (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN r END) OVER (PARTITION BY user_id), 0) AS reset_, coalesce(min(CASE WHEN event_type = 'signup' THEN r END) OVER (PARTITION BY user_id), 1000000000) AS open_ FROM o)
SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS resets, round(coalesce(sum(CASE WHEN r > reset_ AND r > open_ AND event_type NOT IN ('purchase', 'signup') THEN value END), 0.0), 6) AS kept, arg_max(event_type, r) AS last_type FROM p GROUP BY user_id""")
def stream_fold(spark, sf_dir):
    return s.latest(_drained(spark, s.folded(_stream(spark, sf_dir)), "update"), "user_id")


@query("stream_agent_states")
def stream_agent_states(spark, sf_dir):
    return s.latest(_drained(spark, s.agent_states(_stream(spark, sf_dir)), "update"), "user_id")


@query("stream_tasks", """WITH o AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(new_) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS task FROM o),
m AS (SELECT *, max(task) OVER (PARTITION BY user_id) AS last_ FROM n)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'timeout' END AS outcome FROM m GROUP BY user_id, task, last_
HAVING task < last_ OR epoch_ms(max(ts)) + 7200001 < (SELECT epoch_ms(max(ts)) - 600000 FROM events)""")
def stream_tasks(spark, sf_dir):
    """Tasks of users that have ended, two hours after their last event: a later event of the
    user tells them, or a timer once the watermark has passed it. Events of one time go to one
    task, in whatever order they come."""
    return _plain(_drained(spark, s.tasks(_stream(spark, sf_dir), 7_200.0, 7_200.0), "append"))


@query("stream_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    rows = _stream(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    return s.upserted(rows, "user_id", "event_id", f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}")


@query("stream_log_replay", """SELECT CASE WHEN event_id % 2 = 0 THEN 'replayed' ELSE 'live' END AS told, event_type, count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
UNION ALL SELECT 'resumed', event_type, count(*), count(DISTINCT event_id), round(sum(value), 4) FROM events WHERE event_id % 2 = 1 GROUP BY event_type""")
def stream_log_replay(spark, sf_dir):
    """Events go to a log in two runs. A reader from the start gets the first half, and, when it
    goes on, the other one; a second reader resumes behind the first half."""
    spark.dataSource.register(EventLog)
    rows, folder = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), _folder(spark)
    schema = "event_id long, event_type string, value double"

    def tell(half: int) -> None:
        rows.where(F.col("event_id") % 2 == half).repartition(4).write.mode("append").parquet(f"{folder}/in")
        files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        files.writeStream.format("event_log").option("path", f"{folder}/log").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()

    def read(name: str, start: int) -> DataFrame:
        log = spark.readStream.format("event_log").option("path", f"{folder}/log").option("events", schema).option("from", start).load()
        return s.drained(log, "append", f"{folder}/{name}")

    tell(0)
    half = read("all", 0).agg(F.max("offset") + 1, F.max("_batch")).first()
    tell(1)
    told = read("all", 0).withColumn("told", F.when(F.col("_batch") <= half[1], "replayed").otherwise("live"))
    resumed = read("rest", half[0]).withColumn("told", F.lit("resumed"))
    return told.unionByName(resumed).groupBy("told", "event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("stream_tool_calls", """SELECT conv_id AS stream, CAST(turn AS INTEGER) AS index, 'call_' || conv_id || '_' || turn AS call_id, 'tool_' || role AS name,
  CASE WHEN turn % 5 = 4 THEN '{}' ELSE '{"role":"' || role || '","size":[' || length(coalesce(text, '')) || '],"turn":' || turn || '}' END AS arguments, turn % 5 <> 4 AS complete
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL""")
def stream_tool_calls(spark, sf_dir):
    """A call for each turn, its arguments in pieces that three micro-batches hold in turns, so
    that some come too early; every fifth call is cut off and closed by the stream's end."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    size = F.length(F.coalesce("text", F.lit(""))).cast("string")
    text = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit(', "size": ['), size, F.lit('], "role": "'), F.col("role"), F.when(F.col("turn") % 5 == 4, "").otherwise('"}'))
    calls = turns.select(F.col("conv_id").alias("stream"), F.col("turn").cast("int").alias("index"), "role", text.alias("text"))
    pieces = calls.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(".{1,9}"), F.lit(0))).alias("seq", "piece"))
    first = F.col("seq") == 0
    pieces = pieces.select(
        "stream", "index", "seq", F.when(first, F.concat_ws("_", F.lit("call"), F.col("stream").cast("string"), F.col("index").cast("string"))).alias("call_id"),
        F.when(first, F.concat(F.lit("tool_"), "role")).alias("name"), "piece", F.lit(False).alias("ended"),
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("index", "int"), ("seq", "int"), ("call_id", "string"), ("name", "string"), ("piece", "string"))]
    rows = pieces.unionByName(turns.select(F.col("conv_id").alias("stream")).distinct().select("stream", *none, F.lit(True).alias("ended")))
    with stateful(spark):
        stream = s.in_batches(rows, F.when(F.col("ended"), 3).otherwise((F.col("seq") * 2 + F.col("index")) % 3), 4, _folder(spark))
        return _drained(spark, tool_calls(stream, None), "append").drop("_batch")


_TURNS = """turns AS (SELECT user_id AS session_id, event_id AS seq, 'doc' || CAST(event_id % 40 AS VARCHAR) AS source,
  CASE WHEN event_type = 'purchase' THEN 'read' WHEN event_type = 'error' THEN 'no_text' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'end' ELSE 'found' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE 'T' || event_id END AS title, CASE WHEN event_id % 4 <> 0 THEN CAST(2000 + event_id % 25 AS INTEGER) END AS year, 'P' || event_id AS preview FROM events WHERE user_id IS NOT NULL
  UNION ALL SELECT DISTINCT user_id, -1, 'doc0', 'found', 'T0', CAST(NULL AS INTEGER), 'P0' FROM events WHERE user_id IS NOT NULL)"""


@query("stream_session_pool", f"""WITH {_TURNS}, ended AS (SELECT session_id, max(CASE WHEN kind = 'end' THEN seq ELSE -2 END) AS last_end FROM turns GROUP BY session_id),
alive AS (SELECT t.*, min(CASE WHEN kind = 'found' THEN seq END) OVER (PARTITION BY t.session_id, source) AS first_seen FROM turns t JOIN ended e ON t.session_id = e.session_id WHERE seq > last_end)
SELECT session_id, source, coalesce(arg_min(title, seq) FILTER (WHERE kind = 'found' AND title <> ''), '') AS title, arg_min(year, seq) FILTER (WHERE kind = 'found' AND year IS NOT NULL) AS year,
  arg_min(preview, seq) FILTER (WHERE kind = 'found') AS preview, coalesce(bool_or(kind <> 'found' AND seq > first_seen), false) AS is_read,
  coalesce(arg_max(kind = 'read', seq) FILTER (WHERE kind IN ('read', 'no_text') AND seq > first_seen), true) AS has_fulltext FROM alive WHERE first_seen IS NOT NULL GROUP BY session_id, source""")
def stream_session_pool(spark, sf_dir):
    """Pools of sessions after the turns of three micro-batches; every session begins with a
    paper from a table."""
    i, kind = F.col("event_id"), F.col("event_type")
    rows = table(spark, sf_dir, "events").where("user_id is not null")
    turns = rows.select(
        F.col("user_id").alias("session_id"), i.alias("seq"), F.col("ts").cast("timestamp").alias("at"),
        F.when(kind == "purchase", "read").when(kind == "error", "no_text").when((kind == "signup") & (i % 7 == 0), "end").otherwise("found").alias("kind"),
        F.concat(F.lit("doc"), (i % 40).cast("string")).alias("source"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("T"), i.cast("string"))).alias("title"),
        F.when(i % 4 != 0, (2000 + i % 25).cast("int")).alias("year"), F.concat(F.lit("P"), i.cast("string")).alias("preview"),
    )
    pool = rows.select(F.col("user_id").alias("session_id")).distinct().select("session_id", F.lit("doc0").alias("source"), F.lit("T0").alias("title"), F.lit(None).cast("int").alias("year"), F.lit("P0").alias("preview"), F.lit(False).alias("is_read"), F.lit(True).alias("has_fulltext"))
    most = rows.agg(F.max("event_id")).first()[0] or 0
    with stateful(spark):
        stream = s.in_batches(turns, F.floor(F.col("seq") * 3 / (most + 1)), 3, _folder(spark))
        # far beyond the table's time: sessions end by their turns alone
        changes = _drained(spark, session_pool(stream, pool, idle_ms=10**11, delay="3650 days"), "update")
    changes = changes.unionByName(pool.select("*", F.lit(False).alias("dropped"), F.lit(-1).cast("long").alias("_batch")))
    last = changes.groupBy("session_id", "source").agg(F.max_by(F.struct("title", "year", "preview", "is_read", "has_fulltext", "dropped"), "_batch").alias("_")).select("session_id", "source", "_.*")
    return last.where(~F.col("dropped")).drop("dropped")
