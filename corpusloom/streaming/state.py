"""Streams with state by key that ends: tool calls put together from pieces, pools of papers
that sessions keep between turns. Both need the RocksDB state store (see `stateful`)."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which transformWithState asks for."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def scanned(piece: str, depth: int, quoted: bool, escaped: bool) -> tuple[int, bool, bool, int]:
    """Depth of brackets and whether a string or an escape is open after a piece of JSON; and
    the number of its characters up to where the outermost bracket closes (-1: it doesn't)."""
    for i, c in enumerate(piece):
        if escaped:
            escaped = False
        elif quoted:
            quoted, escaped = c != '"', c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return depth, quoted, escaped, i + 1
    return depth, quoted, escaped, -1


def canonical(text: str) -> str | None:
    """The object in one form: keys in order, no blanks; None if it is none."""
    try:
        held = json.loads(text)
    except ValueError:
        return None
    return json.dumps(held, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(held, dict) else None


class _Calls(StatefulProcessor):
    """State of a stream of answers (key): the calls so far, and the pieces that came too early
    (`seq`: a call's next piece, or the piece's own number). A call that is told keeps its index,
    without its text. A batch reads the state once and writes it once, as every call to the
    state store costs a message there and back."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "index int, seq int, early boolean, call_id string, name string, text string, depth int, quoted boolean, escaped boolean", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: ARG002, N802, N803
        ended, came = False, defaultdict(dict)
        for r in rows:
            ended |= r["ended"]
            if not r["ended"] and r["index"] is not None and r["seq"] is not None:
                came[r["index"]][r["seq"]] = (r["call_id"], r["name"], r["piece"])
        calls, early = self._read()
        out = []
        for index in sorted(came):
            out += self._take(index, came[index], calls, early)
        if ended:
            told = {index for index, *_ in out}
            out += [(index, call_id, name, "{}", False) for index, (call_id, name, text, *_) in sorted(calls.items()) if text is not None and name and index not in told]
            self.held.clear()
        elif came:
            self.held.put([(i, c[3], False, *c[:3], *c[4:]) for i, c in calls.items()] + [(i, seq, True, *p, 0, False, False) for i, own in early.items() for seq, p in own.items()])
        yield from (Row(stream=key[0], index=i, call_id=c, name=n, arguments=a, complete=whole) for i, c, n, a, whole in out)

    def _read(self) -> tuple[dict[int, tuple], dict[int, dict[int, tuple]]]:
        """By index the call so far; by index and number the pieces that came too early."""
        calls, early = {}, defaultdict(dict)
        for index, seq, waits, call_id, name, text, *inside in self.held.get():
            if waits:
                early[index][seq] = (call_id, name, text)
            else:
                calls[index] = (call_id, name, text, seq, *inside)
        return calls, early

    def _take(self, index: int, came: dict[int, tuple], calls: dict[int, tuple], early: dict[int, dict[int, tuple]]) -> list[tuple]:
        call_id, name, text, next_, depth, quoted, escaped = calls.get(index, ("", "", "", 0, 0, False, False))
        if text is None:  # told before
            return []
        waiting, out = early.pop(index, {}) | {seq: p for seq, p in came.items() if seq >= next_}, []
        while next_ in waiting:
            more_id, more_name, piece = waiting.pop(next_)
            call_id, name, piece = more_id or call_id, more_name or name, piece or ""
            depth, quoted, escaped, upto = scanned(piece, depth, quoted, escaped)
            text, next_ = text + piece, next_ + 1
            if upto >= 0:
                held = canonical(text[: len(text) - len(piece) + upto])
                if name:
                    out.append((index, call_id, name, held or "{}", held is not None))
                text = None
                break
        if text is not None and waiting:
            early[index] = waiting
        calls[index] = (call_id, name, text, next_, depth, quoted, escaped)
        return out


def tool_calls(pieces: DataFrame, ttl_ms: int | None = HOUR_MS) -> DataFrame:
    """stream, index, call_id, name, arguments, complete: calls put together from pieces (stream,
    index, seq, call_id, name, piece, ended) of one or several batches, in any order.

    A call is told once its arguments' outermost bracket closes; identifier and name may come
    with any piece, the last one given counts. Arguments that are no JSON object are {} and
    not complete. A row that says that the stream has ended tells what is left open in the same
    way and forgets all of it, as does `ttl_ms` without news of the stream, if that isn't None. (With it a query
    goes on until it is stopped: state may run out at any time, so `availableNow` never ends.)
    Calls without a name are left out. Pieces that come twice count once; those after a call
    was told are ignored."""
    shape = "stream long, index int, call_id string, name string, arguments string, complete boolean"
    keyed = pieces.select("stream", "index", "seq", "call_id", "name", "piece", F.coalesce("ended", F.lit(False)).alias("ended")).where("stream is not null").groupBy("stream")
    return keyed.transformWithState(_Calls(ttl_ms), shape, "append", "none" if ttl_ms is None else "processingTime")


PREVIEW = 500
_RECORD = "title string, year int, preview string, is_read boolean, has_fulltext boolean"
_POOL = f"session_id long, source string, {_RECORD}, dropped boolean"


class _Pool(StatefulProcessor):
    """State of a session: its papers, and when it was last heard of. A batch reads the papers
    once and writes them once, as every call to the state store costs a message there and back."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.papers = handle.getListState("papers", f"source string, {_RECORD}")
        self.seen = handle.getValueState("seen", "timer long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:  # noqa: ARG002, N802, N803
        held = self._held()
        for r in initialState.itertuples():
            held[r.source] = (_text(r.title), _number(r.year), _text(r.preview), bool(r.is_read), bool(r.has_fulltext))
        self._keep(held)

    def _held(self) -> dict[str, tuple]:
        return {source: tuple(record) for source, *record in self.papers.get()}

    def _keep(self, held: dict[str, tuple]) -> None:
        if held:
            self.papers.put([(source, *record) for source, record in held.items()])
        else:
            self.papers.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, told = self._held(), set()
        last = 0
        for frame in rows:
            for r in frame.sort_values("seq").itertuples():
                last = max(last, int(r.at_ms))
                if r.kind == "end":
                    told.update(held)
                    held = {}
                    continue
                if not r.source:
                    continue
                now = held.get(r.source)
                if r.kind == "found":
                    title, year = _text(r.title), _number(r.year)
                    new = (title, year, _text(r.preview)[:PREVIEW], False, True) if now is None else (now[0] or title, now[1] if now[1] is not None else year, *now[2:])
                elif now is not None and r.kind in ("read", "no_text"):
                    new = (*now[:3], True, r.kind == "read")
                else:
                    continue
                if new != now:
                    held[r.source] = new
                    told.add(r.source)
        if told:
            self._keep(held)
        if self.seen.exists():
            self.handle.deleteTimer(self.seen.get()[0])
        timer = max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self.handle.registerTimer(timer)
        self.seen.update((timer,))
        yield _rows(key[0], [(s, held.get(s)) for s in sorted(told)])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ARG002, N802, N803
        gone = sorted(self._held())
        self.papers.clear()
        self.seen.clear()
        yield _rows(key[0], [(s, None) for s in gone])


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


def _number(value: object) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def _rows(session: int, papers: list[tuple[str, tuple | None]]) -> pd.DataFrame:
    names = [c.split()[0] for c in _POOL.split(", ")]
    out = pd.DataFrame([(session, s, *(v or ("", None, "", False, False)), v is None) for s, v in papers], columns=names)
    return out.astype({"year": "Int32"})


def session_pool(turns: DataFrame, pool: DataFrame | None = None, idle_ms: int = 24 * HOUR_MS, delay: str = "10 minutes") -> DataFrame:
    """session_id, source, title, year, preview, is_read, has_fulltext, dropped: papers of
    sessions' pools as they change, the last state of each in a batch.

    turns: session_id, seq, at (timestamp), kind, source, title, year, preview. `found` adds a paper
    or fills a missing title or year of a known one; `read` and `no_text` mark a known one, either
    as read; `end` drops the session's pool, and so does `idle_ms` of event time without a turn.
    pool: papers that sessions begin with (session_id, source, title, year, preview, is_read,
    has_fulltext). Turns of a batch are taken in order of seq; those without session, or a
    paper without source, are left out. Previews are cut to 500 characters, as specified."""
    rows = turns.where("session_id is not null").withWatermark("at", delay)
    rows = rows.select("session_id", "seq", "at", F.unix_millis("at").alias("at_ms"), "kind", "source", "title", F.col("year").cast("int").alias("year"), "preview")
    first = None if pool is None else pool.select("session_id", "source", "title", F.col("year").cast("int").alias("year"), "preview", "is_read", "has_fulltext").groupBy("session_id")
    return rows.groupBy("session_id").transformWithStateInPandas(_Pool(idle_ms), _POOL, "update", "eventTime", first)
