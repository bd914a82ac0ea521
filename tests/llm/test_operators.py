"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import json
import re
import time
import zlib

import numpy as np
import pytest

from corpusloom.llm import line_dedup, media, mixing, quality, secrets, tool_calls, toxicity

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def multiset(text, k=5):
    from collections import Counter

    w = [x.lower() for x in WORD.findall(text)]
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def test_line_templates(make):
    rows = [(i, f"{words(12, i)}\nPage {i} of 90 printed by user{i}\nAll rights reserved by them\n{words(9, 500 + i)}") for i in range(1, 8)]
    rows += [(20, rows[0][1]), (21, "Page 3 of 90 printed by user3\n\nend"), (22, None)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring(make(rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_dropped == 0  # the first carrier
    for i in range(2, 8):
        assert got[i].text == f"{words(12, i)}\n{words(9, 500 + i)}" and got[i].n_dropped == 2 and got[i].n_lines == 4
        assert got[i].n_chars == len(got[i].text)
    assert got[21].text == "\nend" and got[22].text is None and got[22].n_lines == 0
    few = {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring(make(rows[:4])).collect()}
    assert set(few.values()) == {0}


@pytest.mark.parametrize("n", [100, 1_000, 10_000])
def test_templates_do_not_depend_on_the_number_of_lines(make, n):
    """Seven constants and five fields of 1,000 values each; ten times the lines drop the same."""
    rng = np.random.default_rng(n)
    fixed, rows = "order was placed online by and delivered".split(), []
    for i in range(n):
        a, b, c, d, e = (f"{chr(97 + k)}{''.join(chr(97 + int(x)) for x in str(v))}" for k, v in enumerate(rng.integers(0, 1000, 5)))
        line = " ".join([*fixed[:5], a, b, fixed[5], c, d, fixed[6], e])
        rows.append((i, f"{words(6, i)}\n{line}\n{words(11, 1_000_000 + i)} {'x' * (i % 7 + 1)}y"))
    got = line_dedup.drop_recurring(make(rows))
    assert got.selectExpr("sum(n_dropped)", "max(n_dropped)", "min(n_dropped)").first() == (n - 1, 1, 0)


def test_several_templates_of_a_leaf(make):
    """Kinds of lines that begin alike keep templates of their own; unlike lines stay."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 9))
    rows = [(i, f"see all of the {'news reports about town' if i % 3 else 'match results for club'} {word()}") for i in range(60)]
    rows += [(100 + i, f"see all of the {word()} {word()} {word()} {word()} {word()}") for i in range(8)]
    rows += [(200 + i, f"we do not know {word()} {word()} {word()}") for i in range(50)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring(make(rows)).collect()}
    assert [i for i in range(60) if not got[i]] == [0, 1] and not any(n for i, n in got.items() if i >= 100)


def test_long_texts_of_recurring_lines(make):
    rows = [(i, "\n".join(f"this is line {j} of them" if j % 2 else f"own {words(3, i * 10**6 + j)}" for j in range(200_000))) for i in range(6)]
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring(make(rows)).select("doc_id", "n_lines", "n_dropped").collect()}
    assert got == {i: (200_000, 100_000 if i else 0) for i in range(6)} and time.time() - began < 90


def test_media_round_trip(documents):
    """Every payload comes back from the sound in its stored form, whatever stands around it."""
    inspected = {r.doc_id: r for r in media.inspect(media.pack(documents)).collect()}
    rows = {r.doc_id: r for r in media.digest(media.inspect(media.pack(documents))).collect()}
    kinds = set()
    for d in documents.collect():
        raw = (d.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r, seen = rows[d.doc_id], inspected[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        blob, declared = media.stored(payload)
        assert (r.media_sha256, r.media_bytes, seen.declared_type) == (hashlib.sha256(blob).hexdigest(), len(blob), declared)
        at = blob.index(b"RIFF")
        cover = [("image/gif", 0, at)] if blob.startswith(b"GIF8") else []
        assert [(c.type, c.start, c.end) for c in seen.carved] == [*cover, ("audio/wav", at, at + len(media.to_wav(payload)))] and r.n_carved == len(cover) + 1
        assert r.detected_type == seen.carved[0].type and r.corrected == (r.detected_type != declared)
        assert r.feature == f"audio/wav;channels=1;rate=8000;bits=8;bytes={len(payload)};{media.feature(payload)}"
        kinds.add((r.detected_type, declared, at > 0))
    assert len(kinds) == 12


def test_features_of_sounds():
    square = bytes([138] * 5 + [118] * 5) * 10
    assert media.feature(square) == "energy=10000;crossings=19;peak=10;loud=0000000000"
    assert media.feature(bytes([128] * 90 + [255] * 10)) == f"energy={127 * 127 * 10};crossings=0;peak=127;loud=0000000001"
    assert media.feature(b"") == "energy=0;crossings=0;peak=0;loud=0000000000"


def test_many_magic_numbers_in_one_blob():
    began = time.time()
    assert media.sniff(b"%PDF-" * 60_000 + b"\x1f\x8b\x08\x00" * 60_000 + b"\xff\xd8\xff\xc0\x00\x08abcd\xff\xda\x00\x02" * 20_000) == []
    assert time.time() - began < 20
    whole = media.sniff(b"%PDF-" * 9 + b"startxref 1 %%EOF")
    assert [(f.kind, f.start, f.end) for f in whole] == [("application/pdf", 0, 62)]


def test_signatures(spark):
    import struct

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0ab\0cd")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0;"
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    packed = gz.compress(b"hello" * 9) + gz.flush()
    bmp = b"BM" + struct.pack("<IHHIIiiHH", 58, 0, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\0\0\0\0"
    blob = b"junk BM RIFF" + png + b"\xff\xd8\xff" + gif + packed + bmp + media.to_wav(b"abc") + png[:-3]
    found = media.sniff(blob)
    assert [f.kind for f in found] == ["image/png", "image/gif", "application/gzip", "image/bmp", "audio/wav"]
    assert blob[found[0].start : found[0].end] == png and blob[found[1].start : found[1].end] == gif and found[2].detail == "bytes=45"
    rows = spark.createDataFrame([(1, bytearray(png), "image/jpeg", "x"), (2, None, None, "x"), (3, bytearray(b""), "text/plain", "x"), (4, bytearray(b"a" + gif), "image/gif", "x")], "id int, media binary, declared_type string, carved string")
    got = {r.id: r for r in media.inspect(rows).collect()}
    assert got[1].corrected and got[1].detected_type == "image/png" and not got[4].corrected and got[4].carved[0].start == 1
    assert got[2].detected_type is None and got[3].carved == [] and not got[3].corrected


def test_toxicity_held_out(spark, documents, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.9 and hit / sum(r.toxic for r in rows) > 0.85
    assert all(toxicity.is_held_out(r.doc_id) for r in rows)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 5.0, toxicity.fold("clown"): 4.0, toxicity.fold("stupi") + "*": 5.0}, ("clown fish",), (-3.0, 2.0, 1.0))
    for text in ("you IDIOT", "an 1d10t!", "аn idiоt", "id­iot", "ídïot", "ｉｄｉｏｔ"):
        assert lexicon.hits(text)[1] == 1, text
    assert lexicon.hits("idiots idiotic xidiot")[1] == 0 and lexicon.hits("stupidity")[1] == 1
    assert lexicon.hits("a clown fish")[1] == 0 and lexicon.hits("a clown fish, you clown")[1] == 1
    assert lexicon.score("") == lexicon.score("fine words") < 0.5 < lexicon.score("you idiot")


def test_quality_held_out(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    model = quality.train(docs, quality.graded(train))
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.keep for r in good) / len(good) > 0.98 and sum(not r.keep for r in bad) / len(bad) > 0.9
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    grade = np.digitize(x @ np.array([2.0, -1.0, 0.0, 0.5]) + rng.logistic(size=3000), [-1.0, 1.5])
    model = quality.fit(x, grade, 3, steps=800)
    assert model.weights[0] > 1.2 and model.weights[1] < -0.5 and abs(model.weights[2]) < 0.3
    assert model.thresholds[0] < model.thresholds[1]


def test_mix_meets_targets(documents, make):
    rows = mixing.mix(documents).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(documents).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    by, sizes = {}, {d.doc_id: len(WORD.findall(d.text or "")) for d in documents.collect()}
    for r in rows:
        assert r.size == sizes[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        by.setdefault(r.source, [0, r.target, 0])
        by[r.source][0] += r.taken
        by[r.source][2] += r.size
    assert all(abs(t - goal) <= 1 for t, goal, _ in by.values())
    total = sum(s for *_, s in by.values())
    assert sum(t for t, *_ in by.values()) == 3 * total // 2  # the budget is met to the word
    assert sum(g for _, g, _ in by.values()) == pytest.approx(1.5 * total)
    # one large source of weight 1 takes what others can't
    few = make([(i, "a b c d") for i in range(0, 300)] + [(1000 + 3 * i, words(50, i)) for i in range(100)])
    assert sum(r.taken for r in mixing.mix(few).collect()) == pytest.approx(1.5 * sum(r.size for r in mixing.mix(few).collect()), abs=4)


PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in found)


SECRETS = [
    "password=hunter22 token: 'abc' SECRET = \"a.b-c_d=+/\" apikey:123456 api_key=x", "secret=token:abcdef", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 14 + " AKIAshort", "0123456789abcdef01234567 " + "f" * 23,
    "é漢😀 token = " + "deadbeef" * 5 + " 😀 passwd='zzzzzz'", "token==abcdef token=\u0001abcdefg", "\x02password:abcdef\x01", None, "", "ghp_" + "a1B2" * 9, "tokentoken=abcdef", "api__key=abcdef", "token\t=abcdef",
]


def test_secrets_against_brute_force(make):
    rows = list(enumerate(SECRETS))
    for r in secrets.scan(make(rows)).collect():
        expected = base_spans(SECRETS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), (SECRETS[r.doc_id], expected, r.spans)
        assert set(filter(None, expected.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(expected.count(k + ":") for k in ("assign", "access", "hex"))


def test_ownership(make):
    shared, own = "token=examplevalue1", "token=ownvalue22222"
    docs = make([(i, shared + (f" {own}" if i == 4 else "")) for i in range(6)])  # sources s0, s1, s2
    got = {r.doc_id: (r.n_live, r.n_shared) for r in secrets.scan(docs).collect()}
    assert got[4] == (1, 1) and got[0] == (0, 1)


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", "answer", '{"question":"q","max_words":3}', 0), (1, "b", "continue", '{"question":"q","context":{"$ref":"a"}}', 2), (1, "c", "continue", '{"question":"q","context":{"$ref":"b"},"max_words":500.0}', 4),
            (1, "d", "answer", "broken", 6), (1, "x", "answer", '{"question":"q","max_words":1,"context":{"$ref":"y"}}', 7), (1, "y", "answer", '{"question":"q","max_words":1,"context":{"$ref":"x"}}', 8),
            (1, "a", "answer", "{}", 9), (2, "a", "none", "{}", 0), (None, "a", "answer", "{}", 0), (2, None, None, None, 1),
        ],
        "conv_id long, call_id string, name string, arguments string, position long",
    )
    results = spark.createDataFrame([(1, "a", "ra", 1), (1, "b", "rb", 3), (1, "b", "late", 5), (1, "z", "orphan", 9), (2, "a", None, 1)], "conv_id long, call_id string, result string, position long")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(calls, results, tool_calls.TOOLS).collect()}
    assert [got[1, k].level for k in "abcdxy"] == [0, 1, 2, 0, None, None]
    assert [got[1, k].valid for k in "abcd"] == [True, True, False, False] and got[1, "z"].status == "no_call" and got[1, "c"].status == "no_result"
    assert got[1, "a"].json == '{"call":{"arguments":{"max_words":3,"question":"q"},"id":"a","name":"answer"},"conversation":1,"errors":[],"level":0,"result":"ra","status":"linked"}'
    c = json.loads(got[1, "c"].json)
    assert c["call"]["arguments"]["max_words"] == 500 and c["errors"] == ["$.context: unknown"] or "above maximum" in str(c["errors"])
    assert len(got) == 10 and json.loads(got[2, "a"].json)["errors"] == ["name: unknown tool none"]


def test_mixed_rows_keep_their_own_words(make):
    rows = [(None, words(30, 1)), (None, words(40, 2)), (3, words(50, 3)), (3, words(50, 3)), (3, words(20, 4)), (6, words(10, 5))]
    docs = make(rows)
    order = lambda d: sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.taken) for r in d.collect())
    got = mixing.mix_documents(docs)
    assert order(got) == order(mixing.mix(docs).where("taken > 0")) and sum(r.doc_id is None for r in got.collect()) == 2
    assert all(len(r.text.split()) == r["size"] and 0 < r.taken <= 2 * r["size"] for r in got.collect())


def test_running_totals_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 40)
    rows = spark.range(1_000).selectExpr("(id * 7919) % 1000 AS at", "id % 13 AS n", "1L AS one")
    got = sorted((r.at, r.n, r.upto_n, r.upto_one) for r in mixing.running(rows, [rows["at"]], "n", "one").collect())
    upto = np.cumsum([n for _, n, *_ in got])
    assert [(u, o) for *_, u, o in got] == [(int(u), i + 1) for i, u in enumerate(upto)]


def test_many_sources_and_rows_without_id(make, spark, monkeypatch):
    """Runs and partitions of a few rows give the same as one of all."""
    docs = make([(None if i % 3 == 0 else i, words(i % 17, i % 50)) for i in range(600)]).drop("source").selectExpr("*", "concat('s', n_chars % 40) AS source")
    order = lambda d: sorted((str(r.source), r.doc_id or -1, r["size"], r.taken) for r in d.collect())
    one = order(mixing.mix(docs))
    monkeypatch.setattr(mixing, "RUN_ROWS", 5)
    assert order(mixing.mix(docs)) == one and sum(x[3] for x in one) == 3 * sum(x[2] for x in one) // 2


def plain_hits(lexicon, text):
    """Words matched, looking at every entry for every word."""
    folded = toxicity.fold(text)
    harmless = [m.span() for e in lexicon.exceptions for m in re.finditer(re.escape(toxicity.fold(e)), folded)]
    harmless = [(a, b) for a, b in harmless if not folded[:a][-1:].isalpha() and not folded[b : b + 1].isalpha()]
    found = []
    for m in re.finditer(r"[^\W\d_]+", folded):
        best = max((w for e, w in lexicon.weights.items() if m[0] == e or e.endswith("*") and m[0].startswith(e[:-1])), default=0)
        best = max([best, *(w for e, w in lexicon.weights.items() if e.endswith("*") and e[:-1] == m[0])])
        if best:
            found.append((m.span(), best))
    return [w for (a, b), w in found if not any(x <= a and b <= y for x, y in harmless)]


def test_toxicity_of_the_whole_table(spark, sf_dir):
    base = sf_dir.replace("sf0.001", "sf0.01")
    documents = spark.read.parquet(f"{base}/documents.parquet")
    lexicon = toxicity.learn(documents, spark.read.parquet(f"{base}/labels.parquet"))
    rows = {r.doc_id: r for r in toxicity.score(documents, lexicon).collect()}
    assert len(rows) == documents.count() and lexicon.weights
    for d in documents.collect():
        hits, r = plain_hits(lexicon, d.text or ""), rows[d.doc_id]
        a, b, c = lexicon.scale
        total, n = sum(hits), (d.text or "").count(" ") + (d.text or "").count("\n") + 1
        x = a + b * np.log1p(total) + c * np.log1p(100 * total / (n + 20)) if total else a
        assert r.n_hits == len(hits) and r.score == pytest.approx(1 / (1 + np.exp(-x))) and r.predicted == (r.score >= 0.5) and r.held_out == toxicity.is_held_out(d.doc_id)


def test_exceptions_are_learned(spark):
    """A word of insults that clean texts hold after another one."""
    rng = np.random.default_rng(41)
    filler = lambda: " ".join(f"word{chr(97 + int(i))}{chr(97 + int(j))}" for i, j in rng.integers(0, 26, (12, 2)))
    texts = [(f"{filler()} you grobnak {filler()}", 1) for _ in range(150)] + [(f"{filler()} you {'grobnak valley' if i < 14 else 'a valley'} {filler()}", 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, (t, _) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert toxicity.fold("grobnak valley") in lexicon.exceptions and len(lexicon.exceptions) == 1
    assert lexicon.score("in grobnak valley") < 0.5 < lexicon.score("grobnak, so") and lexicon.hits("grobnak valley, a grobnak")[1] == 1


def plain_features(text):
    """The features of a text, one run of bytes and one word at a time."""
    half, counts = quality.DIMENSIONS // 2, np.zeros(quality.DIMENSIONS)
    raw = text.encode()
    for i in range(len(raw) - 2):
        counts[(int.from_bytes(raw[i : i + 3], "little") * 2654435761 % 2**32 >> 22) % half] += 1
    found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    for a, b in found:
        code = np.array([raw[a] | raw[b - 1] << 8 | min(b - a, 24) << 16], np.uint64)
        counts[half + int(quality.mix(code)[0] % np.uint64(half))] += 1
    x = np.log1p(counts)
    x /= max(np.sqrt((x * x).sum()), 1e-6)
    kinds = {raw[a:b].lower() for a, b in found}
    return np.append(x, [len(kinds) / max(len(found), 1), min(len(found), 50) / 50])


def test_quality_of_the_whole_table(spark, documents, sf_dir):
    model = quality.train(documents, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = {r.doc_id: r for r in quality.classify(documents, model).collect()}
    docs = documents.collect()
    assert rows.keys() == {d.doc_id for d in docs}
    for d in docs:
        tails = 1 / (1 + np.exp(-(plain_features(d.text or "") @ model.weights - model.thresholds)))
        r = rows[d.doc_id]
        assert r.tail == pytest.approx(tails[0], abs=1e-3) and r.expected_grade == pytest.approx(tails.sum(), abs=1e-3)
        assert r.keep == (r.tail >= 0.5 and bool((d.text or "").split()))
