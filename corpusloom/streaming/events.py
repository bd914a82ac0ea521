"""Event streams: windows, duplicates, folds by task, a keyed state machine, upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "10 minutes"


def timed(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Events with ts as a timestamp (their zone is the session's, UTC) and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    rows = timed(events).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour") -> DataFrame:
    rows = timed(events).groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "n")


def deduplicated(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key within the watermark's reach."""
    return timed(events).dropDuplicatesWithinWatermark(list(keys))


# Users' states lie in so many blocks: a call of Python and a row of state for each block and
# batch cost what they would for one user.
BLOCKS = 1024


def _in_blocks(step: Callable[[list, tuple], None], first: tuple, out: Callable[[list], tuple], names: list[str]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """A state for each user of a block, `first` at the start, which `step` changes by an event
    (its columns after user, ts and event_id), in order of time; `out` of those that had events."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {user: list(own) for user, *own in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        users = [None] * len(rows) if key[0] < 0 else rows.user_id.tolist()
        for user, *event in zip(users, *(rows[c].tolist() for c in rows.columns.drop(["block", "user_id", "ts", "event_id"], errors="ignore")), strict=True):
            own = held.get(user)
            if own is None:
                own = held[user] = list(first)
            step(own, event)
        state.update(tuple(map(list, zip(*((user, *own) for user, own in held.items()), strict=True))))
        seen = dict.fromkeys(users)
        yield pd.DataFrame([(user, *out(held[user])) for user in seen], columns=names).astype({"user_id": "Int64"})

    return run


def _by_user(events: DataFrame, columns: list[str], run: Callable, shape: str, state: str) -> DataFrame:
    block = F.when(F.col("user_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(BLOCKS)).cast("int"))
    rows = events.select(block.alias("block"), "user_id", "event_id", *columns, F.col("ts").cast("timestamp").alias("ts"))
    lists = ", ".join(f"{name} array<{kind}>" for name, kind in (x.split() for x in f"user_id long, {state}".split(", ")))
    return rows.groupBy("block").applyInPandasWithState(run, shape, lists, "update", GroupStateTimeout.NoTimeout)


def _fold(own: list, event: tuple) -> None:
    """n events; a purchase resets what was gathered, values count after a signup only."""
    kind, value = event
    own[0], own[4] = own[0] + 1, kind
    if kind == "purchase":
        own[1], own[2] = own[1] + 1, 0.0
    elif kind == "signup":
        own[3] = True
    elif own[3]:
        own[2] += float(value)


def folded(events: DataFrame) -> DataFrame:
    """A row for each user and trigger: the state after the events seen so far."""
    run = _in_blocks(_fold, (0, 0, 0.0, False, ""), lambda s: (s[0], s[1], round(s[2], 6), s[4]), ["user_id", "n", "resets", "kept", "last_type"])
    return _by_user(events, ["event_type", "value"], run, "user_id long, n long, resets long, kept double, last_type string", "n long, resets long, kept double, open boolean, last string")


# Calls that each state of an agent may make, calls in all, and states entered.
BUDGETS = {"retrieve": 2, "quick_read": 3, "deep_read": 4}
MOST_CALLS, MOST_LOOPS = 15, 8
ORDER = ("retrieve", "quick_read", "deep_read", "respond")


def _advance(own: list, event: tuple) -> None:
    """Calls move a task on when a state's budget is used up; errors use it up as well. A signup
    while reading asks for another search. A purchase, the last call or the last state that may
    be entered makes the task respond, whatever comes then."""
    at, used, calls, failed, loops = own
    end, kind = len(ORDER) - 1, event[0]
    if at == end:
        return
    calls, used, failed = calls + 1, used + 1, failed + (kind == "error")
    if calls >= MOST_CALLS or kind == "purchase":
        to = end
    elif kind == "signup" and at:
        to = 0
    elif used >= BUDGETS[ORDER[at]]:
        to = at + 1
    else:
        own[:] = at, used, calls, failed, loops
        return
    loops += 1
    own[:] = end if loops > MOST_LOOPS else to, 0, calls, failed, loops


def agent_states(events: DataFrame) -> DataFrame:
    """A row for each user and trigger: where the user's task stands."""
    run = _in_blocks(_advance, (0, 0, 0, 0, 1), lambda s: (ORDER[s[0]], *s[2:]), ["user_id", "state", "calls", "failed", "loops"])
    return _by_user(events, ["event_type"], run, "user_id long, state string, calls long, failed long, loops int", "at int, used int, calls long, failed long, loops int")


def in_batches(rows: DataFrame, part: Column, batches: int, folder: str) -> DataFrame:
    """The rows as a stream of so many micro-batches: those whose `part` is 0 come first, and so
    on. They are written to `folder` one part after the other, by as many tasks as run at once;
    each part gets the same number of files, empty ones if need be, as a batch is told by it."""
    spark, at = rows.sparkSession, f"{folder}/in"
    files = spark.sparkContext.defaultParallelism
    for i in range(batches):
        rows.where(part == i).repartition(files).write.mode("append").parquet(at)
        for _ in range((i + 1) * files - len(spark.read.schema(rows.schema).parquet(at).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(at)


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """All that a stream gives for what is there now, as a table: its batches are written to
    `folder` with their numbers and read back; state and progress are kept beside them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("_batch", "long")).parquet(f"{folder}/rows/batch=*")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of updates of each key the last."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "_batch")]), "_batch").alias("_"))
    return best.select(key, "_.*")


def upserted(stream: DataFrame, key: str, order: str, folder: str) -> DataFrame:
    """Micro-batches merged into a keyed table: of each key the row with the highest order, of
    equal ones the later batch's. A batch adds the best of its own rows under its number,
    which a batch that is run again overwrites; readers merge what is there, so a stream that
    goes on from its checkpoint finds all that it had."""
    spark = stream.sparkSession
    columns = [c for c in stream.columns if c != key]

    def add(batch: DataFrame, number: int) -> None:
        best = batch.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_")).select(key, "_.*")
        best.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/rows")
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, "batch")).alias("_")).select(key, "_.*")


_TASK_OUT = "user_id long, started timestamp, ended timestamp, n long, outcome string"


def _tasks(idle: float, keep: float) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def closed(user: int, state: tuple) -> tuple:
        started, ended, n, done = state
        return (user, pd.Timestamp(started, unit="us"), pd.Timestamp(ended, unit="us"), n, "done" if done else "timeout")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """A task goes on while events come within `idle` seconds, or within `keep` once it
        is done; then it is told and forgotten."""
        held, out = state.get if state.exists else None, []
        if state.hasTimedOut:
            out.append(closed(key[0], held))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for at, kind in zip(rows.ts.astype("datetime64[us]").astype("int64"), rows.event_type, strict=True):
                if held is not None and at - held[1] > 1e6 * (keep if held[3] else idle):
                    out.append(closed(key[0], held))
                    held = None
                started, _, n, done = held or (int(at), int(at), 0, False)
                held = (started, int(at), n + 1, done or kind == "purchase")
            state.update(held)
            state.setTimeoutTimestamp(max(int(held[1] / 1e3 + 1e3 * (keep if held[3] else idle)), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["user_id", "started", "ended", "n", "outcome"])

    return step


def tasks(events: DataFrame, idle: float = 30.0, keep: float = 60.0, delay: str = DELAY) -> DataFrame:
    """A row for each task of a user that has ended: by timeout, `idle` seconds after its last
    event, or `keep` seconds after that if a purchase had finished it. Timers by event time
    end tasks that no further event comes for, so that no state stays for ever."""
    rows = timed(events, delay).select("user_id", "event_id", "event_type", "ts")
    state = "started long, ended long, n long, done boolean"
    return rows.groupBy("user_id").applyInPandasWithState(_tasks(idle, keep), _TASK_OUT, state, "append", GroupStateTimeout.EventTimeTimeout)
