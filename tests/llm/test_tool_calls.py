"""Tool calls: odd JSON, order in blocks, and the whole table against a version without Spark."""

import json
from collections import defaultdict

import pytest

from corpusloom.llm import tool_calls

CALL = "conv_id long, call_id string, name string, arguments string, position long, extra string"
RESULT = "conv_id long, call_id string, result string, position long, name string"
ODD = {
    "half": ('{"question":"\\ud800"}', "half a surrogate pair"), "half key": ('{"\\udfff":1}', "half a surrogate pair"), "pair": ('{"question":"\\ud83d\\ude00","max_words":1}', None),
    "deep": ('{"question":' + "[" * 2_000 + "]" * 2_000 + "}", "nested too deep"), "very deep": ("[" * 200_000 + "]" * 200_000, "nested too deep"), "nan": ('{"max_words":NaN}', "not JSON"),
    "infinite": ('{"max_words":-Infinity}', "not JSON"), "large": ('{"max_words":1e400}', "not JSON"), "digits": ("9" * 5_000, "not JSON"), "null": (None, "not JSON"), "empty": ("", "not JSON"),
    "list": ("[1,2]", "not object"), "twice": ('{"question":"a","question":"b","max_words":2}', None), "long": ('{"question":"' + "x" * 500_000 + '","max_words":1}', None),
}


def test_odd_arguments(spark):
    calls = spark.createDataFrame([(1, k, "answer", v, None if k == "null" else i, "e") for i, (k, (v, _)) in enumerate(ODD.items())] * 2, CALL)
    results = spark.createDataFrame([(1, k, None, i, "n") for i, k in enumerate(ODD)] + [(None, None, None, None, None)], RESULT)
    got = tool_calls.link(calls, results, tool_calls.TOOLS).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        if r.call_id is None:
            assert r.status == "no_call" and json.loads(r.json)["errors"] == ["identifier: missing"]
            continue
        wrong = ODD[r.call_id][1]
        held = json.loads(r.json, parse_constant=pytest.fail)
        assert r.valid == (wrong is None) and r.status == "linked" and (wrong is None or wrong in held["errors"][0]), r.call_id
    assert json.loads(next(r.json for r in got if r.call_id == "twice"))["call"]["arguments"] == {"question": "b", "max_words": 2}


def graph():
    rows = [(1, f"c{i}", i, [f"c{j}" for j in (i - 1, i - 3) if j >= 0] + ["gone"]) for i in range(40)]
    rows += [(1, "p", 50, ["q"]), (1, "q", 51, ["p"]), (1, "r", 52, ["q", "c1"]), (1, "self", 53, ["self"]), (2, "c5", 0, None), (2, "c6", 0, ["c5", "c5"])]
    return rows + [(3, f"back{i}", i, [f"back{i + 1}"] if i < 20 else []) for i in range(21)]


def expected_levels(rows):
    needs = {(c, k): [(c, n) for n in ns or ()] for c, k, _, ns in rows}
    level: dict = {}
    while True:
        new = {k: max([level[n] + 1 for n in ns if n in needs], default=0) for k, ns in needs.items() if k not in level and all(n in level for n in ns if n in needs)}
        if not new:
            return {k: level.get(k) for k in needs}
        level |= new


@pytest.mark.parametrize("block", [7, 100_000])
def test_levels_do_not_depend_on_blocks(spark, block):
    calls = spark.createDataFrame(graph(), "conv_id long, call_id string, position long, needs array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(calls, block=block).collect()}
    assert got == expected_levels(graph()) and got[1, "c39"] == 39 and got[1, "r"] is None and got[3, "back0"] == 20


def test_a_chain_of_100_000_calls_ends(spark):
    calls = spark.range(100_000).selectExpr("1L AS conv_id", "concat('c', id) AS call_id", "id AS position", "array(concat('c', id - 1)) AS needs")
    got = tool_calls.levels(calls, block=30_000)
    assert got.selectExpr("count(*)", "max(level)", "count(distinct level)").first() == (100_000, 99_999, 100_000)


def test_whole_table(spark, sf_dir):
    """All of conversations, linked anew in plain Python."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(*tool_calls.derived(turns), tool_calls.TOOLS).collect()}
    calls, results = defaultdict(list), defaultdict(list)
    for t in turns.collect():
        if t.role == "user":
            context = {"context": {"$ref": f"call_{t.turn - 2}"}} if t.turn >= 2 else {}
            question = {"question": t.text} if t.text is not None else {}
            size = {"max_words": len(t.text.split(" "))} if t.text is not None else {"max_words": -1}
            calls[t.conv_id, f"call_{t.turn}"].append((t.turn, question | size | context))
        elif t.role == "assistant":
            results[t.conv_id, f"call_{t.turn - 1}"].append((t.turn, t.text or ""))
    assert got.keys() == calls.keys() | results.keys()
    for key, r in got.items():
        assert r.status == ("no_call" if key not in calls else "linked" if key in results else "no_result")
        if key not in calls:
            continue
        at, value = min(calls[key], key=lambda c: c[0])
        level, back = 0, at
        while back >= 2 and (key[0], f"call_{back - 2}") in calls:
            level, back = level + 1, back - 2
        assert (r.position, r.level) == (at, level)
        known = tool_calls.TOOLS["continue" if at >= 2 else "answer"]["properties"]
        good = "question" in value and (at >= 2 or value["question"] != "") and (at < 2 or value["max_words"] <= 400) and (at >= 2 or value["max_words"] >= 1) and value.keys() <= known.keys()
        assert r.valid == (good and key in results), (value, r.json)
        assert json.loads(r.json)["call"]["arguments"] == value and r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
