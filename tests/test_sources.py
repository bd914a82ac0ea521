"""Sources that take predicates, versioned tables, entities, evidence, remembered calls."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import identity, remembered
from corpusloom.operators import entities
from corpusloom.operators.chunking import pack
from corpusloom.sources import paged, versions

YEARS = ";".join(str(y) for y in range(2000, 2020))


@pytest.fixture
def service(spark, tmp_path):
    """A source that notes every page it is asked for, and a function that reads the notes."""
    notes = str(tmp_path)

    def fetch(page):
        import os
        import uuid

        with open(os.path.join(notes, uuid.uuid4().hex), "w") as f:
            json.dump(page, f)
        rows = [(i, f"f{i % 2}", f"{page.query}-{i}") for i in range(250)]
        return [r for r in rows if page.field in (None, r[1])][page.offset : page.offset + page.limit]

    paged.register(spark, paged.paged_source("noted", "n long, field string, title string", fetch))

    def asked():
        found = [paged.Page(*json.loads(p.read_text())) for p in tmp_path.iterdir()]
        for p in tmp_path.iterdir():
            p.unlink()
        return found

    return lambda **more: spark.read.format("noted").options(queries="a;b", years=YEARS, **more).load(), asked


def test_only_shards_that_can_match_are_asked_for(service):
    load, asked = service
    cases = {
        "year >= 2017 and query = 'a'": {("a", y) for y in (2017, 2018, 2019)},
        "year > 2017 and year < 2019": {(q, 2018) for q in "ab"},
        "year in (2003, 2050) and query in ('b', 'c')": {("b", 2003)},
        "year = 1999": set(),
        "2001 <= year and year <= 2001 and n < 5": {(q, 2001) for q in "ab"},
        "year <> 2003 and query = 'a' and year < 2005": {("a", y) for y in (2000, 2001, 2002, 2003, 2004)},  # left to Spark in part
    }
    for where, shards in cases.items():
        got = load().where(where).collect()
        pages = asked()
        assert {(p.query, p.year) for p in pages} == shards and len(pages) == 3 * len(shards), where
        n = 5 if "n < 5" in where else 250
        kept = {s for s in shards if s[1] != 2003} if "<>" in where else shards
        assert len(got) == n * len(kept)


def test_a_field_goes_to_the_service(service):
    load, asked = service
    got = load().where("field = 'f1' and year = 2005").collect()
    pages = asked()
    assert {p.field for p in pages} == {"f1"} and len(pages) == 4 and len(got) == 250 and {r.field for r in got} == {"f1"}
    assert load().where("field in ('f1', 'f0') and year = 2005").count() == 500 and {p.field for p in asked()} == {None}
    assert load().where("field = 'f1' and field = 'f0' and year = 2005").count() == 0


def test_done_shards_and_most_rows(service):
    load, asked = service
    got = load(done=json.dumps([["a", 2001], ["b", 2000]]), most="120").where("year < 2002").collect()
    assert {(p.query, p.year) for p in asked()} == {("a", 2000), ("b", 2001)} and len(got) == 240


@pytest.fixture
def at(spark, tmp_path):
    path = str(tmp_path / "table")
    versions.commit(spark.range(10).withColumn("v", F.lit("one")), path)
    return path


def values(spark, path, version=None):
    return Counter(r.v for r in versions.read(spark, path, version).collect())


def test_versions_and_rollback(spark, at):
    assert versions.rewrite(spark, at, lambda df: df.withColumn("v", F.lit("two")).where("id < 5")) == 2
    assert values(spark, at) == {"two": 5} and values(spark, at, 1) == {"one": 10}
    assert versions.rollback(spark, at, 1) == 3 and values(spark, at) == {"one": 10} and values(spark, at, 2) == {"two": 5}
    assert versions.vacuum(spark, at, keep=1) == 1 and versions.versions(spark, at) == [3] and values(spark, at) == {"one": 10}
    with pytest.raises(ValueError):
        versions.read(spark, at, 1)


def test_a_job_that_dies_changes_nothing(spark, at, monkeypatch):
    """In a task, or between data and manifest."""
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division"):
        versions.rewrite(spark, at, lambda df: df.withColumn("v", (F.lit(1) / (F.col("id") - 3)).cast("string")))
    with monkeypatch.context() as m:
        m.setattr(versions, "_put", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            versions.commit(spark.range(3).withColumn("v", F.lit("lost")), at)
    assert versions.versions(spark, at) == [1] and values(spark, at) == {"one": 10}
    assert versions.commit(spark.range(2).withColumn("v", F.lit("next")), at) == 2 and values(spark, at) == {"next": 2}
    assert versions.vacuum(spark, at) >= 1 and values(spark, at, 1) == {"one": 10}


def test_of_two_writers_one_wins(spark, at):
    first = lambda name: spark.range(3).withColumn("v", F.lit(name))
    assert versions.commit(first("a"), at, base=1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(first("b"), at, base=1)
    assert values(spark, at) == {"a": 3} and versions.versions(spark, at) == [1, 2]


def test_writers_at_the_same_time(spark, at):
    from concurrent.futures import ThreadPoolExecutor

    def write(name):
        try:
            return versions.commit(spark.range(3).withColumn("v", F.lit(name)), at, base=1)
        except versions.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [w for w in pool.map(write, "abcd") if w]
    assert won == [2] and sum(values(spark, at).values()) == 3


def test_entities(spark):
    rows = [(1, "p1", None, "t"), (2, None, "d1", "t"), (3, "p1", "d1", None), (4, None, None, "t"), (5, "p9", None, "t"), (6, None, "", "u"), (7, None, None, "u"), (8, None, None, ""), (9, None, "d9", "u"), (10, None, None, None)]
    table = spark.createDataFrame(rows, "record long, paper_id string, doi string, title string")
    members = entities.resolve(table, "record", ("paper_id", "doi"), "title")
    assert {r.record: r.entity for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 6, 10: 10}
    got = {r.entity: r for r in entities.merged(table, members, "record").collect()}
    assert (got[1].records, got[1].paper_id, got[1].doi, got[1].title) == (4, "p1", "d1", "t")
    edges = spark.createDataFrame([(2, 5), (1, 5), (3, 4), (7, 9), (10, 4)], "src long, dst long")
    assert sorted(map(tuple, entities.between(edges, members, "record").collect())) == [(1, 5), (10, 1)]
    assert entities.resolve(table.limit(0), "record", ("paper_id", "doi"), "title").count() == 0


def test_a_hot_title_and_a_long_chain(spark):
    rows = [(i, f"p{i // 2}", f"d{(i + 1) // 2}", "t") for i in range(200)] + [(1000 + i, None, None, "hot") for i in range(2000)]
    got = entities.resolve(spark.createDataFrame(rows, "record long, paper_id string, doi string, title string"), "record", ("paper_id", "doi"), "title")
    assert Counter(r.entity for r in got.collect()) == {0: 200, 1000: 2000}


def test_evidence(spark):
    def found(meta, pages):
        df = spark.createDataFrame([(meta, pages)], "m map<string,string>, p array<string>")
        r = df.select(identity.doi_by_evidence(F.col("m"), F.col("p")).alias("d")).first().d
        return r and tuple(r)

    long = "10.1016/j.joule.2020.1"
    assert found({"/Subject": f"in {long}.", "/crossmark:doi": f"doi:{long};"}, []) == (long, "/crossmark:doi")
    assert found({"/doi": "", "/DOI": "10.1/x", "/subject": f"see {long}"}, ["x"]) == (long, "/Subject")
    assert found({}, ["first", "10.1016 / j.joule.\n2020.1 end", "more", "10.1016/other.other"]) == (long, "first pages")
    assert found(None, ["a", "b", "c", f"DOI: {long}"]) == (long, "last page") and found(None, ["a", "b"]) is None and found(None, None) is None
    assert found({}, ["A  1 0 . 1 0 1 6 / j . j o u l e . 2 0 2 0 . 1  and 1 0 . 5"]) == (long, "first pages")


def test_a_second_run_asks_nothing(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    at = str(calls)

    def model(texts):
        import os
        import uuid

        with open(os.path.join(at, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)] + [(50, "bad one"), (51, None)], "id long, text string").repartition(4)
    held, n = remembered.remembered(rows, "text", model, store, batch=3)
    assert n == 8 and held.count() == 8
    assert {r.answer for r in held.collect()} == {None, *(f"TEXT {i}" for i in range(7))}
    assert [r.error for r in held.collect() if r.error] == ["RuntimeError: no"]
    for f in calls.iterdir():
        f.unlink()
    _, n = remembered.remembered(rows, "text", model, store)
    assert n == 1 and {f.read_text() for f in calls.iterdir()} == {"bad one"}  # an error is asked again, nothing else
    _, n = remembered.remembered(rows.where("id < 40"), "text", model, store)
    assert n == 0


def test_chunks_of_a_model_or_of_the_packer(spark, tmp_path):
    good, bad, short = "a" * 400 + "\n---\n" + "b" * 2500 + "\n---\nshort", "c" * 900 + "\n\n" + "d" * 1500, "e" * 350

    def model(texts):
        if any(t.startswith("c") for t in texts):
            raise RuntimeError("down")
        return ["too short" if t.startswith("e") else t for t in texts]

    rows = spark.createDataFrame([(1, good), (2, bad), (3, short), (4, None), (5, good)], "id long, text string")
    got = sorted((r.id, r.chunk_no, r.content, r.by_model) for r in remembered.chunked(rows, "id", "text", model, str(tmp_path / "s"), pack).collect())
    want = [(i, n, c, True) for i in (1, 5) for n, c in enumerate(("a" * 400, "b" * 2000))] + [(i, n, c, False) for i, t in ((2, bad), (3, short)) for n, c in enumerate(pack(t))]
    assert got == sorted(want)
