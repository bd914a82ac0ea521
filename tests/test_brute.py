"""Queries that SQL can't express, or hardly, against plain Python over the whole tables."""

import math
import re
from collections import Counter, defaultdict
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import registry
from corpusloom.functions import answers
from corpusloom.functions import vocabulary as v
from corpusloom.functions.expansion import variants
from corpusloom.functions.registry import openai_form
from corpusloom.operators import chunking, composites, curation, ranking, retrieval, upkeep
from corpusloom.plans.standins import papers
from corpusloom.plans.texts import _framed
from corpusloom.sources import records
from corpusloom.streaming import events as s

QUERIES = registry.queries()


def collected(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def title_of(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (text or "").lower())).strip()


def like(a, b):
    """Whether two normalised titles share 85 % of their runs of three characters."""
    if a == b:
        return True
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return bool(x and y) and 100 * len(x & y) >= 85 * len(x | y)


def greedy(rows):
    """rows: (id, title, citations) in order; ids kept."""
    kept = []
    for i, t, c in rows:
        if not t:
            kept.append((i, None, c))
            continue
        at = next((k for k, (_, other, _) in enumerate(kept) if other is not None and like(t, other)), None)
        if at is None:
            kept.append((i, t, c))
        elif c > kept[at][2]:
            kept[at] = (i, t, c)
    return {i for i, *_ in kept}


def test_greedy_titles(spark, sf_dir):
    rows = [(r.doc_id, title_of(r.title), r.citations or 0) for r in papers(spark, sf_dir).orderBy("doc_id").collect()]
    got = {r.doc_id for r in collected(spark, sf_dir, "title_dedup_greedy") if r.kept}
    assert got == greedy(rows)


def test_titles_that_drift(spark):
    """Chains in which each title is like the next alone, repeated titles, and none."""
    rng = np.random.default_rng(7)
    base = "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 64))
    chain = [base[2 * i : 2 * i + 44] for i in range(8)]
    rows = [(i, [*chain, "other one", "", None][int(rng.integers(0, 11))], int(rng.integers(0, 6))) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, title string, c int")
    got = {r.id for r in curation.greedy_titles(frame, "id", "title", "c").where("kept").collect()}
    assert got == greedy([(i, title_of(t), c) for i, t, c in rows]) and any(not like(chain[0], t) for t in chain) and like(chain[0], chain[1])


def test_corpus_curation(spark, sf_dir):
    rows = papers(spark, sf_dir).orderBy("doc_id").collect()
    venue = {r.doc_id: r.venue_normalized for r in papers(spark, sf_dir).select("doc_id", curation.normalize_venue(F.col("venue")).alias("venue_normalized")).collect()}
    good = [r for r in rows if (r.citations or 0) >= 5 or r.year >= 2026 or venue[r.doc_id] in v.GOOD_VENUES]
    best: dict = {}
    for r in good:
        if r.doi and (r.doi.lower() not in best or r.citations > best[r.doi.lower()].citations):
            best[r.doi.lower()] = r
    one = [r for r in good if not r.doi or best[r.doi.lower()].doc_id == r.doc_id]
    kept = greedy([(r.doc_id, title_of(r.title), r.citations or 0) for r in one])
    wanted = sorted(((-r.citations, r.doc_id) for r in one if r.doc_id in kept))
    assert [(-r.citations, r.doc_id) for r in collected(spark, sf_dir, "corpus_curation")] == wanted


def scores(docs, query, k):
    """BM25 of a query over texts by id: the k best."""
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / max(len(docs), 1)
    df = Counter(w for ws in words.values() for w in set(ws))
    found = {}
    for i, ws in words.items():
        tf = Counter(ws)
        total = sum(c * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for w, c in Counter(re.findall("[a-z0-9]+", query.lower())).items() if tf[w])
        if round(total, 9) > 0:
            found[i] = round(total, 9)
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]


def hybrid_by_hand(docs, vectors, query, vector, k):
    keyword: dict = {}
    for i, sc in scores([(d.doc_id, d.text) for d in docs], query, 2 * k):
        keyword[{d.doc_id: d.source for d in docs}[i]] = max(keyword.get({d.doc_id: d.source for d in docs}[i], 0), sc)
    facts = {d.doc_id: d for d in docs}
    near = sorted(((float(np.dot(vector, e)), i) for i, e in vectors if i in facts and vector is not None), key=lambda x: (-x[0], x[1]))[: 2 * k]
    boosted = [(sim * (0.9 if facts[i].tier == 1 else 0.8) * (min(1 + 0.1 * math.log10(facts[i].citations + 1), 1.3) if facts[i].citations else 1.0), facts[i].source) for sim, i in near]
    semantic: dict = {}
    top = max((x for x, _ in boosted), default=0)
    for x, source in boosted:
        semantic[source] = max(semantic.get(source, -9), x / top if top > 0 else x)
    share = lambda d: {s_: x / max(d.values()) for s_, x in d.items()}
    keyword, semantic = share(keyword) if keyword else {}, share(semantic) if semantic else {}
    return {s_: 0.7 * semantic.get(s_, 0) + 0.3 * keyword.get(s_, 0) for s_ in keyword.keys() | semantic.keys()}


def test_expanded_search(spark, sf_dir):
    docs = papers(spark, sf_dir).where("year >= 2012").select("doc_id", "text", "source", "tier", "citations").collect()
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    known = dict(vectors)
    got = defaultdict(list)
    for r in collected(spark, sf_dir, "expanded_search"):
        got[r.query_id].append((r["rank"], r.source, r.score))
    for item in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()[:12]:
        best: dict = {}
        for variant in variants(item.text):
            fused = hybrid_by_hand(docs, vectors, variant, known.get(item.item_id), 20)
            for source, sc in sorted(fused.items(), key=lambda x: (-round(x[1], 12), x[0]))[:20]:
                best[source] = max(best.get(source, -9), round(sc, 9))
        wanted = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [(s_, pytest.approx(x, abs=2e-6)) for _, s_, x in sorted(got[item.item_id])] == wanted


def test_filters_hold_before_both_sides(spark):
    """60 documents of which 10 are new enough: these are searched, by words and by vectors."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, f"text {i} of words", f"s{i}", 1, i, "Nature", 2020 if i >= 50 else 2000) for i in range(60)], "doc_id long, text string, source string, tier int, citations int, venue string, year int")
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, "nothing shared", rng.normal(size=8).tolist())], "query_id long, query_text string, query_vector array<double>")
    got = composites.search(docs, vectors, queries, 5, year_min=2010).collect()
    assert len(got) == 5 and all(int(r.source[1:]) >= 50 for r in got)


def test_bm25_in_blocks_and_pieces(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    queries = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id AS query_id", "text AS query_text")
    one = sorted(map(tuple, retrieval.bm25(docs, queries, 7).collect()))
    for name, value in (("TEXT_QUERY_BLOCK", 7), ("PIECE", 30), ("QUERY_TERMS", 200)):
        monkeypatch.setattr(retrieval, name, value)
    assert sorted(map(tuple, retrieval.bm25(docs, queries, 7).collect())) == one and len(one) > 100


def test_nearest_in_blocks_and_passes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)], "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(50)], "query_id long, query_vector array<double>")
    one = sorted(map(tuple, retrieval.nearest(rows, asked, 5).collect()))
    for name, value in (("QUERY_BLOCK", 7), ("QUERY_VALUES", 100), ("_SCORES", 90)):
        monkeypatch.setattr(retrieval, name, value)
    assert sorted(map(tuple, retrieval.nearest(rows, asked, 5).collect())) == one and len(one) == 250


def test_ties_of_the_best(spark):
    rows = spark.createDataFrame([(i, [1.0 if i % 3 else 2.0, 0.0]) for i in range(500)] + [(900, None)], "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None)], "query_id long, query_vector array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval.nearest(rows, asked, 4).collect()}
    assert [got[1, n] for n in (1, 2, 3, 4)] == [0, 3, 6, 9] and [got[2, n] for n in (1, 2, 3, 4)] == [1, 2, 4, 5] and len(got) == 8


def test_filename_matching(spark, sf_dir):
    pairs = defaultdict(list)
    for r in collected(spark, sf_dir, "filename_theta_join"):
        pairs[r.doi].append(r.file)
    taken, wanted = set(), set()
    for doi in sorted(pairs):
        free = next((f for f in sorted(pairs[doi]) if f not in taken), None)
        if free is not None:
            taken.add(free)
            wanted.add((doi, free))
    assert {(r.doi, r.file) for r in collected(spark, sf_dir, "filename_matching")} == wanted and wanted


def test_matching_takes_no_rounds(spark):
    """A chain of wishes: every row wants what the one before it takes."""
    n = 3_000
    pairs = spark.range(n).selectExpr("format_string('o%05d', id) AS o", "array(format_string('f%05d', id - 1), format_string('f%05d', id)) AS fs").selectExpr("o", "explode(fs) AS f").where("f >= 'f'")
    got = {r.o: r.f for r in upkeep.one_to_one(pairs, "o", "f").collect()}
    assert len(got) == n and all(f == f"f{int(o[1:]) - 1:05d}" or o == "o00000" for o, f in got.items() if o != "o00000")


def marked_by_hand(text, fake):
    for one in fake:
        for form in (f"[📄](/api/pdf/{one})", f"[📄](/api/pdf/{one}.pdf)", f"[📄]({one})", f"[📄]({one}.pdf)"):
            text = text.replace(form, f"[⚠️ 未验证引用](/api/pdf/{one})")
    return text


def fake_of(text, validated):
    found = [x.replace(".pdf", "") for p in answers.CITED for x in re.findall(p, text)]
    return [x for x in dict.fromkeys(found) if x not in validated], len(dict.fromkeys(found))


def test_answers(spark, sf_dir):
    from corpusloom.plans.answers import _answers

    given = {(r.conv_id, r.turn): r for r in _answers(spark, sf_dir).collect()}
    rewritten = {(r.conv_id, r.turn): r.answer for r in collected(spark, sf_dir, "citation_rewrite")}
    checked = {(r.conv_id, r.turn): r for r in collected(spark, sf_dir, "checked_answers")}
    assert rewritten.keys() == checked.keys() == given.keys()
    for key, r in given.items():
        fake, n = fake_of(r.answer, r.validated)
        marked = marked_by_hand(r.answer, fake)
        assert rewritten[key] == marked and checked[key].n_cited == n
        assert checked[key].answer == re.sub(answers.SUGGESTIONS, "", marked).rstrip(" ")


def test_chunks(spark, sf_dir):
    """Every row of the chunking queries is what the rule gives for its whole text."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    framed = {r.doc_id: r.text or "" for r in _framed(spark, sf_dir).collect()}
    for name, rule, texts in (("chunk_pack_2000", chunking.pack, docs), ("udtf_split", chunking.pack, docs), ("chunk_recursive", chunking.split, docs), ("paragraph_repair", chunking.repair, framed)):
        rows = collected(spark, sf_dir, name)
        column = "content" if "content" in rows[0] else "text"
        got = {(r.doc_id, r.idx if "idx" in r else 0): r[column] for r in rows}
        wanted = {(i, n): part for i, t in texts.items() for n, part in enumerate([rule(t)] if name == "paragraph_repair" else rule(t))}
        assert got == wanted, name
    for t in docs.values():
        parts = chunking.split(t)
        assert all(0 < len(p) <= 500 for p in parts) and sum(map(len, parts)) >= 0.8 * len(re.sub(r"\s+", " ", t).strip())


def test_segments(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    got = defaultdict(list)
    for r in chunking.segments(docs, most=700).orderBy("doc_id", "idx").collect():
        got[r.doc_id].append(r.content)
    for r in docs.where("text is not null").collect():
        wanted, now, n = [], [], 0
        for p in r.text.split("\n\n"):
            if n + len(p) > 700 and now:
                wanted.append("\n\n".join(now))
                now, n = [p], len(p)
            else:
                now, n = [*now, p], n + len(p)
        assert got[r.doc_id] == [*wanted, "\n\n".join(now)]


def test_expansion_and_vectors(spark, sf_dir):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert {(r.item_id, r.variant_no, r.variant) for r in collected(spark, sf_dir, "query_expansion")} == {(i, n, x) for i, t in items.items() for n, x in enumerate(variants(t))}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    vectors = {r.doc_id: np.array(r.embedding) for r in collected(spark, sf_dir, "embed_documents")}
    assert vectors.keys() == texts.keys() and all(abs(np.linalg.norm(x) - 1) < 1e-5 or not np.any(x) for x in vectors.values())
    held = [r for r in collected(spark, sf_dir, "chunks_with_vectors")]
    assert {(r.doc_id, r.content) for r in held} == {(i, p) for i, t in texts.items() for p in chunking.pack(t) if len(p) >= chunking.LEAST} and all(len(r.embedding) == 64 for r in held)


def tasks_by_hand(rows, idle, keep):
    out, held = [], None
    for at, kind in rows:
        if held and at - held[1] > timedelta(seconds=keep if held[3] else idle):
            out.append(held)
            held = None
        held = [held[0] if held else at, at, (held[2] if held else 0) + 1, bool(held and held[3]) or kind == "purchase"]
    return out, held


def test_tasks_end_by_timers(spark, sf_dir, tmp_path):
    idle, keep = 3_600.0, 7_200.0
    out = s.drained(s.tasks(s.in_batches(spark.read.parquet(f"{sf_dir}/events.parquet"), F.lit(0), 1, str(tmp_path / "files")), idle, keep), "append", str(tmp_path / "out")).collect()
    by = defaultdict(list)
    for e in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").collect():
        by[e.user_id].append((e.ts, e.event_type))
    last = max(at for rows in by.values() for at, _ in rows) - timedelta(minutes=10)
    wanted, open_ = set(), set()
    for user, rows in by.items():
        done, held = tasks_by_hand(rows, idle, keep)
        wanted |= {(user, a, b, n, "done" if d else "timeout") for a, b, n, d in done}
        tail = (user, *held[:3], "done" if held[3] else "timeout")
        (wanted if held[1] + timedelta(seconds=(keep if held[3] else idle) + 1) < last else open_).add(tail)
    got = {(r.user_id, r.started, r.ended, r.n, r.outcome) for r in out}
    assert got >= wanted and got <= wanted | open_ and len(wanted) > 20


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "user_id long, event_id long, value double"
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    spark.createDataFrame([(1, 1, 1.0), (2, 5, 2.0)], schema).coalesce(1).write.mode("append").parquet(source)
    assert {tuple(r) for r in s.upserted(stream(), "user_id", "event_id", folder).collect()} == {(1, 1, 1.0), (2, 5, 2.0)}
    spark.createDataFrame([(1, 9, 3.0), (2, 4, 9.0), (3, 1, 4.0)], schema).coalesce(1).write.mode("append").parquet(source)
    wanted = {(1, 9, 3.0), (2, 5, 2.0), (3, 1, 4.0)}
    assert {tuple(r) for r in s.upserted(stream(), "user_id", "event_id", folder).collect()} == wanted
    assert {tuple(r) for r in s.upserted(stream(), "user_id", "event_id", folder).collect()} == wanted  # nothing new


def test_appended_rows_are_new(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, x string"
    spark.createDataFrame([(1, "a")], schema).write.parquet(path)
    more = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c"), (None, "e"), (3, None)], schema)
    assert records.append_new(more, path, "id") == 2 and records.append_new(more, path, "id") == 0
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (3, None)}


def test_numbers_over_ranges(spark):
    rows = spark.range(5_000).selectExpr("(id * 7919) % 5000 AS x")
    got = ranking.numbered(rows, [F.col("x").desc()], part_rows=300).collect()
    assert {(r.id, r.x) for r in got} == {(4_999 - x, x) for x in range(5_000)}


def test_schemas_of_tools():
    form = openai_form("search", "finds", {"query": "what to find", "top_k": "how many", "year": "Number of a year"})
    assert form["function"]["parameters"]["properties"] == {"query": {"type": "string", "description": "what to find"}, "top_k": {"type": "integer", "description": "how many"}, "year": {"type": "integer", "description": "Number of a year"}}
    assert form["function"]["parameters"]["required"] == ["query", "top_k", "year"] and form["type"] == "function"


def test_shared_folder_is_no_machines_own(monkeypatch):
    from corpusloom import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Session())
