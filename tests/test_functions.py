"""Helpers against plain Python, and operators that SQL can't express."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import identity
from corpusloom.functions import text as t
from corpusloom.functions.classify import intent, question_type
from corpusloom.functions.expansion import variants
from corpusloom.functions.registry import Tool, Tools, embed_stub
from corpusloom.operators import chunking, curation, materials, ranking, upkeep
from corpusloom.operators.graph import connected
from corpusloom.sources import records
from corpusloom.sources.paged import paged_source, register


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("_")).first()[0]


def test_variants():
    assert variants("perovskite stability") == ["perovskite stability", "perovskite degradation", "perovskite lifetime"]
    assert variants("what is the best way to improve large area defect passivation")[:2] == ["what is the best way to improve large area defect passivation", "improve large area defect passivation"]
    assert variants("what is the best way to improve large area defect passivation")[2] == "improve scalable defect passivation"
    assert variants("one two three four five six seven")[-1] == "one two three four five"
    assert variants("") == [] and variants(None) == [] and variants("the of") == ["the of"]


def test_pack():
    assert chunking.pack("x" * 299) == [] and chunking.pack("x" * 300) == ["x" * 300]
    parts = chunking.pack("\n\n".join(["a" * 900, "b" * 900, "c" * 900, "d" * 100]))
    assert parts == ["a" * 900 + "\n\n" + "b" * 900, "c" * 900 + "\n\n" + "d" * 100]
    long = chunking.pack("word. " * 2000)
    assert all(300 <= len(p) <= 2000 for p in long)
    assert chunking.pack("s" * 100 + "\n\n" + "t" * 1950) == ["s" * 100 + "\n\n" + "t" * 1898]


def test_split():
    text = ". ".join(f"sentence number {i} with some words" for i in range(60))
    parts = chunking.split(text)
    assert all(len(p) <= 500 for p in parts)
    assert all(a[-20:] in text and b[:20] in text for a, b in zip(parts, parts[1:], strict=False))
    assert any(b[:30] in a for a, b in zip(parts, parts[1:], strict=False))
    assert chunking.split("x" * 1200) and chunking.split("") == []


def test_repair():
    assert chunking.repair("exam-\nple of it\nnext line goes\non here\n\nRESULTS\nmore") == "example of it\n\nnext line goes on here\n\n\n\nRESULTS\n\nmore"
    assert chunking.repair("") == ""


def test_title_and_ngrams(spark):
    assert one(spark, t.normalize_title(F.col("x")), x="  Über: A-b_c,  D! ") == "über a b_c d"
    assert one(spark, t.ngram_jaccard(F.col("x"), F.col("y")), x="abcd", y="abce") == pytest.approx(1 / 3)
    assert one(spark, t.ngram_jaccard(F.col("x"), F.col("y")), x="", y="abc") == 0
    assert one(spark, t.ngram_jaccard(F.col("x"), F.col("y")), x="ab", y="ab") == 1
    assert one(spark, t.printable(F.col("x")), x="a\x00b\tc\nd") == "a b\tc\nd"


def test_passages_are_normalised(spark):
    assert one(spark, t.normalize_passage(F.col("x")), x="## **Bold** ﬁt, ＡＢ\n# x") == "bold fit ab x"


def test_questions(spark):
    for text, kind in (("Compare perovskite A vs B", "specific"), ("give me an overview", "broad"), ("perovskite", "broad"), ("", "broad"), ("which doping works", "specific")):
        assert one(spark, question_type(F.col("x")), x=text) == kind
    assert one(spark, intent(F.col("x")), x="thanks") == "chat"
    assert one(spark, intent(F.col("x")), x="find recent papers on stability") == "research"


def test_identifiers(spark):
    assert one(spark, identity.doi_to_filename(F.col("x")), x="10.1038/s1/2") == "10.1038_s1_2.pdf"
    assert one(spark, identity.filename_to_dois(F.col("x")), x="10.1_a_b_c.pdf") == ["10.1/a/b_c", "10.1/a/b/c", "10.1/a/b/c"][:1] + ["10.1/a/b/c", "10.1/a/b/c"]
    assert one(spark, identity.doi_in_text(F.col("x")), x="title " * 9 + "see 10.1234/abcdefgh12. end") == "10.1234/abcdefgh12"
    assert one(spark, identity.year_in_name(F.col("x")), x="a_2021_b") == 2021 and one(spark, identity.year_in_name(F.col("x")), x="ab") is None
    assert one(spark, identity.guess_url(F.col("x")), x="10.1038/abc") == "https://www.nature.com/articles/abc.pdf"


def test_graph(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5)], "a long, b long")
    assert {r.node: r.component for r in connected(pairs).collect()} == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(4, 10), 4)}


def test_greedy_titles(spark):
    rows = [(1, "the quick brown fox jumps over", 3), (2, "The quick brown fox jumps over!", 9), (3, "quite another title of a paper", 0), (4, "the quick brown fox jumps over it", 9), (5, "", 1), (6, None, 1)]
    kept = {r.id: r.kept for r in curation.greedy_titles(spark.createDataFrame(rows, "id long, title string, c int"), "id", "title", "c").collect()}
    assert kept == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}


def test_matching_is_greedy(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 2), ("c", 3)], "doi string, file int")
    assert {(r.doi, r.file) for r in upkeep.one_to_one(pairs, "doi", "file").collect()} == {("a", 1), ("c", 2)}


def test_diverse_pick(spark):
    rng = pd.Series(range(200))
    rows = [(int(i % 3), int(i), f"j{(i * i) % 7}", float((i * 37) % 50)) for i in rng]
    pool = spark.createDataFrame(rows, "item_id long, id long, journal string, score double")
    got = {}
    for r in ranking.diverse(pool, "item_id", 4).collect():
        got.setdefault(r.item_id, {})[r.place] = r.id
    for item in range(3):
        chosen, seen = [], set()
        for _, i, j, _s in sorted((r for r in rows if r[0] == item), key=lambda r: (-r[3], r[1])):
            if len(chosen) == 4:
                break
            if j not in seen or len(chosen) >= 3:
                chosen.append(i)
                seen.add(j)
        assert [got[item][p] for p in sorted(got[item])] == chosen


def test_tolerance(spark):
    rows = {r.formula: r for r in materials.tolerance(spark.createDataFrame([("MAPbI3",), ("Cs0.1FA0.9PbI3",), ("CsPb(Br0.5I0.5)3",), ("??",)], "formula string")).collect()}
    assert round(rows["MAPbI3"].t, 4) == 0.9115 and rows["MAPbI3"].crystal == "cubic" and rows["MAPbI3"].stable
    assert round(rows["Cs0.1FA0.9PbI3"].r_a, 4) == 2.465 and round(rows["CsPb(Br0.5I0.5)3"].r_x, 4) == 2.08
    assert rows["??"].t is None


def test_matchings_by_rounds(spark):
    """A dense component, random ones and a chain longer than the rounds, against one row after the other."""
    rng = __import__("random").Random(5)
    cases = [[(f"o{rng.randrange(60):02d}", rng.randrange(60)) for _ in range(n)] for n in (0, 80, 900)]
    cases.append([(i, j) for i in range(100) for j in (i - 1, i)])  # each waits for the one before
    cases.append([(100 + i, 0) for i in range(300)] + [(7, j) for j in range(300)])
    for pairs in cases:
        given, want = set(), {}
        for o in sorted({o for o, _ in pairs}):
            free = sorted(p for q, p in pairs if q == o and p not in given)
            if free:
                want[o] = free[0]
                given.add(free[0])
        kind = "string" if pairs and isinstance(pairs[0][0], str) else "long"
        df = spark.createDataFrame([*pairs, (None, 1)], f"o {kind}, p long")
        for rounds in (12, 3):
            assert {r.o: r.p for r in upkeep.one_to_one(df, "o", "p", rounds).collect()} == want


def test_formulas(spark):
    """Brackets at any depth, cations without a radius, texts that are no formula."""
    made = ["Cs0.1(MA0.5[FA2GA]3)2Pb(Br0.5I0.5)3", "ACPbI3", "Fe3", "MA0.7 Pb and more?", "no symbols here ~", "Cs(Pb", "CsPb)I3", "", None, "((Cs))2PbI3", "(" * 40 + "Cs" + ")2" * 40 + "PbI3", "AcPbI3"]
    got = {r.f: r for r in spark.createDataFrame([(f,) for f in made], "f string").select("f", materials.species(F.col("f")).alias("p"), materials.sites(F.col("f")).alias("s")).collect()}
    of = lambda f: [(p.symbol, round(p.amount, 6)) for p in got[f].p]
    assert of(made[0]) == [("Cs", 0.1), ("MA", 1.0), ("FA", 12.0), ("GA", 6.0), ("Pb", 1.0), ("Br", 1.5), ("I", 1.5)]
    assert of("ACPbI3")[0] == ("AC", 1) and of("Fe3") == [("Fe", 3)] and of("((Cs))2PbI3")[0] == ("Cs", 2) and of(made[10])[0] == ("Cs", 2.0**40) and of("AcPbI3")[0] == ("Ac", 1)
    assert [got[f].s.scanned for f in made[:8]] == [False, False, False, True, True, True, True, False] and got[None].s is None
    text = got["MA0.7 Pb and more?"].s
    assert [(p.symbol, p.amount) for p in text.a] == [("MA", 0.7)] and [p.symbol for p in text.b] == ["Pb"] and [(p.symbol, p.amount) for p in text.x] == [("I", 3.0)]
    rows = {r.formula: r for r in materials.tolerance(spark.createDataFrame([(f,) for f in made] * 2, "formula string")).collect()}
    assert rows["ACPbI3"].r_a == 1.5 and rows["ACPbI3"].t is not None and rows[None].t is None and rows["no symbols here ~"].t is None
    iron = spark.range(1).select(materials.ionic_radius(F.lit("Fe3"), F.lit(6)).alias("r"), materials.ionic_radius(F.lit("Fe"), F.lit(4)).alias("q")).first()
    assert (iron.r, iron.q) == (0.645, 0.78)


def test_tools(spark):
    tools = Tools()
    tools.add(Tool("half", "half of a number", {}, lambda n: 1 / n))
    calls = spark.createDataFrame([("half", '{"n": 2}'), ("half", '{"n": 0}'), ("none", "{}"), ("half", "broken")], "name string, arguments string")
    got = tools.apply(calls).collect()
    assert got[0].result == "0.5" and got[0].error is None and all(r.result is None and r.error for r in got[1:])
    assert tools.table(spark).count() == 1


def test_embedding_is_unit(spark):
    v = spark.createDataFrame([("a b c",), (None,)], "x string").select(embed_stub(8)("x").alias("v")).collect()
    assert sum(a * a for a in v[0].v) == pytest.approx(1, abs=1e-6) and set(v[1].v) == {0.0}


def test_paged_source(spark):
    def fetch(page):
        return [(f"{page.query}-{page.year}-{i}",) for i in range(page.offset, min(page.offset + page.limit, 250))]

    register(spark, paged_source("papers_test", "title string", fetch))
    rows = spark.read.format("papers_test").option("queries", "a;b").option("years", "2020;2021").option("most", "220").load()
    assert rows.groupBy("query", "year").count().collect() and rows.count() == 880


def test_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"doi": "A", "n": 1}\n\n{"doi": "a ", "n": 2}\n{"doi": null, "n": 3}\n')
    rows = records.json_lines(spark, str(tmp_path / "a"), "doi string, n int")
    assert [(r.key, r.n) for r in records.keyed(rows, F.col("doi"), "n").collect()] == [("a", 2)]
    listed = records.files(spark, str(tmp_path), "*.jsonl")
    assert [r.name for r in records.first_by_name(listed).collect()] == ["x.jsonl"]
    out = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(out)
    assert records.append_new(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), out, "k") == 1
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]
    records.write_split(rows, str(tmp_path / "split"), "n")
    assert spark.read.parquet(str(tmp_path / "split")).count() == 3
