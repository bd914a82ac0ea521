"""Every operator over an empty table and over one of odd rows."""

import pytest

from corpusloom.llm import decontaminate, language, lexical, line_dedup, media, mixing, near_dup, passages, quality, secrets, tool_calls, toxicity

ITEMS = [(0, None), (1, ""), (2, "one"), (None, "a b c d e f g"), (3, "w1 w2")]


def operators(spark, labels):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {
        "matches": lambda d: decontaminate.matches(d, items),
        "without_matches": lambda d: decontaminate.without_matches(d, items),
        "near": near_dup.near_duplicates,
        "keep_one": near_dup.keep_one,
        "lines": line_dedup.drop_recurring,
        "media": lambda d: media.digest(media.inspect(media.pack(d))),
        "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, labels)),
        "quality": lambda d: quality.classify(d, quality.train(d, quality.graded(labels))),
        "select_good": lambda d: quality.select_good(d, labels),
        "mix": mixing.mix,
        "mix_documents": mixing.mix_documents,
        "secrets": secrets.scan,
        "passages": passages.repeated_passages,
        "search": lambda d: lexical.search(lexical.build(d), d, items),
        "language": lambda d: language.identify(d, language.learn(d)),
    }


NAMES = ("matches", "without_matches", "near", "keep_one", "lines", "media", "toxicity", "quality", "select_good", "mix", "mix_documents", "secrets", "passages", "search", "language")
PER_ROW = {"near", "lines", "media", "toxicity", "quality", "mix", "secrets", "language"}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, spark, make, labels):
    assert operators(spark, labels)[name](make([])).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, spark, odd, labels):
    got = operators(spark, labels)[name](odd).collect()
    if name in PER_ROW:
        assert len(got) == 16
    else:
        assert len(got) <= 16 or name in ("passages", "search")


def test_empty_labels_and_items(spark, odd, labels):
    none = labels.limit(0)
    assert quality.train(odd, quality.graded(none)) is None
    assert quality.select_good(odd, none).count() == 16
    assert {r.score for r in toxicity.score(odd, toxicity.learn(odd, none)).collect()} == {0.5}
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(odd, items).count() == 0
    assert decontaminate.without_matches(odd, items).count() == 16


def test_tool_calls_empty(spark):
    calls = spark.createDataFrame([], "conv_id long, call_id string, name string, arguments string, position long")
    results = spark.createDataFrame([], "conv_id long, call_id string, result string, position long")
    assert tool_calls.link(calls, results, {}).count() == 0
