"""Tool calls of conversations: linked to their results, put in order, validated, and
written as canonical JSON.

Calls meet results in a join on conversation and call identifier. A call that refers to
the results of others comes after them: its level is one above theirs. Calls are dealt
out by conversation and position into blocks of bounded size; every block puts in order
what it can, and waves hand levels on to the blocks that wait for them. Arguments are
checked against the tool's schema, and each call with its result becomes one line of JSON
with sorted keys and no spare blanks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Calls of a block that is put in order as a whole, about.
BLOCK = 100_000
#: Arguments that nest deeper are an error of their call; JSON lets a reader set such a limit.
DEPTH = 200
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value: type, enum, required, properties, additionalProperties,
    items, minimum, maximum and minLength are looked at."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        right = isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
        right = right or kind == "integer" and isinstance(value, float) and value.is_integer()
    else:
        right = kind is None or isinstance(value, _TYPES.get(kind, object))
    if not right:
        return [f"{at}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{at}: too short")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                found += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += violations(v, schema["items"], f"{at}[{i}]")
    return found


def _nested(value: object) -> Iterator[tuple[object, int]]:
    """The value and all within it, with their depth, without recursion."""
    open_ = [(value, 1)]
    while open_:
        held, depth = open_.pop()
        yield held, depth
        if isinstance(held, dict):
            open_ += [(v, depth + 1) for pair in held.items() for v in pair]
        elif isinstance(held, list):
            open_ += [(v, depth + 1) for v in held]


def references(value: object) -> list[str]:
    """Identifiers of the calls whose results a value refers to, as {"$ref": identifier}, sorted."""
    return sorted({v["$ref"] for v, _ in _nested(value) if isinstance(v, dict) and isinstance(v.get("$ref"), str)})


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks, whole numbers without a fraction."""

    def plain(v: object) -> object:
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError(text)
    return value


def parsed(text: str | None) -> tuple[object, str | None]:
    """The value of a JSON text, or what is wrong with it: NaN, infinities, numbers out of
    range and halves of surrogate pairs are no JSON that another reader must take."""
    try:
        value = json.loads(text or "", parse_constant=_no_constant, parse_float=_number)
    except ValueError:
        return None, "arguments: not JSON"
    except RecursionError:
        return None, "arguments: nested too deep"
    for held, depth in _nested(value):
        if depth > DEPTH:
            return None, "arguments: nested too deep"
        if isinstance(held, str) and not held.isascii() and any("\ud800" <= c <= "\udfff" for c in held):
            return None, "arguments: half a surrogate pair"
    return value, None


def _checked(batches: Iterator[pa.RecordBatch], schemas: dict) -> Iterator[pa.RecordBatch]:
    """Adds references and errors of every call."""
    for batch in batches:
        refs, errors = [], []
        for name, text in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist(), strict=True):
            value, wrong = parsed(text)
            refs.append(references(value))
            errors.append([wrong] if wrong else [f"name: unknown tool {name}"] if name not in schemas else violations(value, schemas[name]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(refs, pa.list_(pa.string())), pa.array(errors, pa.list_(pa.string()))], names=[*batch.schema.names, "needs", "errors"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = []
        for r in batch.to_pylist():
            value, wrong = parsed(r["arguments"])
            call = None if r["name"] is None and r["arguments"] is None else {"id": r["call_id"], "name": r["name"], "arguments": r["arguments"] if wrong else value}
            lines.append(canonical({"conversation": r["conv_id"], "call": call, "result": r["result"], "status": r["status"], "level": r["level"], "errors": r["errors"] or []}))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "call_id", "position", "level", "status")), pa.array([not e and s == "linked" for e, s in zip(batch.column("errors").to_pylist(), batch.column("status").to_pylist(), strict=True)]), pa.array(lines, pa.string())], names=["conv_id", "call_id", "position", "level", "status", "valid", "json"])


def order(needs: dict, base: dict) -> dict:
    """Levels of those calls that can be told: base without a need, else one more than the
    highest needed if that is more. Calls in a circle or behind one are left out."""
    level: dict = {}
    open_ = {c: set(ns) for c, ns in needs.items()}
    behind: dict = {}
    for c, ns in open_.items():
        for n in ns:
            behind.setdefault(n, []).append(c)
    high = dict(base)
    ready = [c for c, ns in open_.items() if not ns]
    while ready:
        c = ready.pop()
        level[c] = high[c]
        for w in behind.get(c, ()):
            high[w] = max(high[w], level[c] + 1)
            open_[w].discard(c)
            if not open_[w]:
                ready.append(w)
    return level


_CALL = "block int, conv_id long, call_id string, base int, inner array<string>, outer array<string>"


def _ordered(table: pa.Table) -> pa.Table:
    """A block of calls with the levels that can be told: those of calls that wait for none
    in another block, nor for one that does."""
    keys = list(zip(table.column("conv_id").to_pylist(), table.column("call_id").to_pylist(), strict=True))
    inner, outer = table.column("inner").to_pylist(), table.column("outer").to_pylist()
    needs = {k: [(k[0], n) for n in ns or ()] + [None] * bool(o) for k, ns, o in zip(keys, inner, outer, strict=True)}
    level = order(needs, dict(zip(keys, table.column("base").to_pylist(), strict=True)))
    # needs whose levels are known by now are in base from here on
    base = [max([b, *(level[k[0], n] + 1 for n in ns or () if (k[0], n) in level)]) for k, b, ns in zip(keys, table.column("base").to_pylist(), inner, strict=True)]
    inner = [[n for n in ns or () if (k[0], n) not in level] for k, ns in zip(keys, inner, strict=True)]
    return pa.table({
        "block": table.column("block"), "conv_id": table.column("conv_id"), "call_id": table.column("call_id"), "base": pa.array(base, pa.int32()),
        "inner": pa.array(inner, pa.list_(pa.string())), "outer": pa.array(outer, pa.list_(pa.string())), "level": pa.array([level.get(k) for k in keys], pa.int32()),
    })


def levels(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """calls (conv_id, call_id, position, needs; each call once) to conv_id, call_id, level: 0
    for calls that need no other call that is there, else one more than the highest needed;
    null in a circle or behind one.

    Blocks are ranges of conversation and position, so that references, which go to calls
    shortly before as a rule, seldom leave one; a large conversation lies in many. There are
    as many waves as blocks follow each other along a chain of references."""
    key = ["conv_id", "call_id"]
    n = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-calls.count() // block))
    placed = cut(calls.select(*key, "position", "needs").repartitionByRange(n, "conv_id", "position", "call_id").select(*key, "needs", F.spark_partition_id().alias("block")))
    edges = placed.select(*key, "block", F.explode(F.array_distinct("needs")).alias("need"))
    edges = edges.join(placed.select("conv_id", F.col("call_id").alias("need"), F.col("block").alias("at")), ["conv_id", "need"])
    needs = lambda inside: F.collect_list(F.when((F.col("at") == F.col("block")) == F.lit(inside), F.col("need")))
    needed = cut(edges.groupBy(*key).agg(needs(True).alias("inner"), needs(False).alias("outer")))
    waiting = placed.join(needed, key, "left").select("block", *key, F.lit(0).alias("base"), "inner", "outer")
    done = None
    while True:
        known = cut(waiting.groupBy("block").applyInArrow(_ordered, _CALL + ", level int"))
        told = known.where("level is not null").select(*key, "level")
        done = told if done is None else done.unionByName(told)
        left = known.where("level is null")
        hits = left.select(*key, F.explode("outer").alias("need")).join(told.select("conv_id", F.col("call_id").alias("need"), "level"), ["conv_id", "need"])
        hits = cut(hits.groupBy(*key).agg((F.max("level") + 1).alias("above"), F.collect_list("need").alias("got")))
        if hits.isEmpty():
            return done.unionByName(left.select(*key, "level"))
        waiting = left.join(hits, key, "left").select("block", *key, F.greatest("base", "above").alias("base"), "inner", F.when(F.col("got").isNull(), F.col("outer")).otherwise(F.array_except("outer", "got")).alias("outer"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, call_id, name, arguments (JSON), position; results: conv_id, call_id,
    result, position. schemas: JSON schemas of the tools' arguments, by name.

    Returns conv_id, call_id, position, level, status (linked, no_result, no_call), valid
    (linked and without errors), json: a row for each call and for each result without
    one; (level, position) is the order in a conversation.

    Of calls, or results, that repeat an identifier within a conversation the first by
    position counts; ties go to the lesser content. Null identifiers or conversations meet
    nothing, and every such row stays; a null position is before all others. A null or broken
    argument text is an error, as are NaN, infinities, numbers out of range, halves of
    surrogate pairs and nesting beyond DEPTH; of a key that an object repeats the last value
    counts. An unknown tool is an error. A reference to a call that isn't there doesn't wait.
    Conversations are never gathered: rows are joined on both keys. Other columns are
    ignored. Empty tables give empty results.
    """
    key = ["conv_id", "call_id"]
    known = "conv_id is not null and call_id is not null"
    first = lambda df, *cols: df.where(known).groupBy(*key).agg(F.min(F.struct("position", *cols)).alias("_")).select(*key, "_.*")
    calls = calls.select(*key, "name", "arguments", "position")
    results = results.select(*key, "result", "position")
    linkable = cut(first(calls, "name", "arguments").mapInArrow(lambda b: _checked(b, schemas), "conv_id long, call_id string, position long, name string, arguments string, needs array<string>, errors array<string>"))
    leveled = linkable.join(levels(linkable), key).withColumn("called", F.lit(True))
    got = first(results, "result").withColumnRenamed("position", "result_position").withColumn("answered", F.lit(True))
    joined = leveled.join(got, key, "full_outer")
    rows = joined.select(
        *key, F.coalesce("position", "result_position").alias("position"), "level", "name", "arguments", "result", "errors",
        F.when(F.col("called").isNull(), "no_call").when(F.col("answered").isNull(), "no_result").otherwise("linked").alias("status"),
    )
    odd = calls.where(f"not ({known})").select(*key, "position", F.lit(None).cast("int").alias("level"), "name", "arguments", F.lit(None).cast("string").alias("result"), F.array(F.lit("identifier: missing")).alias("errors"), F.lit("no_result").alias("status"))
    lost = results.where(f"not ({known})").select(*key, "position", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "result", F.array(F.lit("identifier: missing")).alias("errors"), F.lit("no_call").alias("status"))
    return rows.unionByName(odd).unionByName(lost).mapInArrow(_written, "conv_id long, call_id string, position long, level int, status string, valid boolean, json string")


#: Tools of the calls that `derived` makes of conversations.
TOOLS: dict[str, dict] = {
    "answer": {"type": "object", "required": ["question", "max_words"], "additionalProperties": False, "properties": {"question": {"type": "string", "minLength": 1}, "max_words": {"type": "integer", "minimum": 1}, "context": {"type": "object"}}},
    "continue": {"type": "object", "required": ["question", "context"], "additionalProperties": False, "properties": {"question": {"type": "string"}, "max_words": {"type": "integer", "maximum": 400}, "context": {"type": "object"}}},
}


def derived(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as tool calls: a user's turn calls a tool (answer at first, then
    continue, which refers to the call two turns before), an assistant's turn is the result
    of the turn before it. Null texts give null questions; turns that are repeated give calls
    that are; a null turn or conversation is carried as it is, and its call has no identifier;
    an empty table gives none."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("position"), "role", F.col("text").cast("string").alias("text"))
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    t = F.col("position")
    arguments = F.to_json(F.struct(F.col("text").alias("question"), F.size(F.split("text", " ")).alias("max_words"), F.when(t >= 2, F.struct(name(t - 2).alias("$ref"))).alias("context")))
    calls = rows.where("role = 'user'").select("conv_id", name(t).alias("call_id"), F.when(t >= 2, "continue").otherwise("answer").alias("name"), arguments.alias("arguments"), "position")
    results = rows.where("role = 'assistant'").select("conv_id", name(t - 1).alias("call_id"), F.col("text").alias("result"), "position")
    return calls, results


#: The same over the calls that `derived` makes, in DuckDB's SQL: a user's turn waits for the
#: one two turns before, so levels count turns that follow each other in steps of two.
SQL = """
WITH calls AS (SELECT conv_id, turn, text, len(string_split(text, ' ')) AS n, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM conversations WHERE role = 'user'),
leveled AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level, 'call_' || turn AS call_id,
  CASE WHEN turn < 2 AND text = '' THEN '"$.question: too short"' WHEN turn >= 2 AND n > 400 THEN '"$.max_words: above maximum"' ELSE '' END AS errors FROM calls),
results AS (SELECT conv_id, turn, text, 'call_' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
both_ AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS position, c.level, c.turn, c.n, c.text, coalesce(c.errors, '') AS errors, r.text AS result,
  CASE WHEN c.conv_id IS NULL THEN 'no_call' WHEN r.conv_id IS NULL THEN 'no_result' ELSE 'linked' END AS status FROM leveled c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, position, CAST(level AS INTEGER) AS level, status, status = 'linked' AND errors = '' AS valid,
  '{"call":' || CASE WHEN status = 'no_call' THEN 'null' ELSE '{"arguments":{' || CASE WHEN turn >= 2 THEN '"context":{"$ref":"call_' || (turn - 2) || '"},' ELSE '' END || '"max_words":' || n || ',"question":' || CAST(to_json(text) AS VARCHAR)
    || '},"id":"' || call_id || '","name":"' || CASE WHEN turn >= 2 THEN 'continue' ELSE 'answer' END || '"}' END || ',"conversation":' || conv_id || ',"errors":[' || errors || '],"level":' || coalesce(CAST(level AS VARCHAR), 'null')
    || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS json FROM both_
"""
