"""Queries of text cleaning, chunking and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import classify as c
from corpusloom.functions import text as t
from corpusloom.functions import vocabulary as v
from corpusloom.operators import chunking
from corpusloom.plans.standins import PAPERS, papers, pick, quoted, sql_list
from corpusloom.registry import query
from corpusloom.session import table

# Documents dressed as papers: captions, page numbers, headings and notices around the text.
_FRAMES = (
    ("", "\n\n\n\nReferences\n1. Smith\n"),
    ("12\nFigure 1. Plot of it\n", "\nhttps://doi.org/10.1000/x1\nJanuary 15, 2024\nmore"),
    ("<!-- Start of picture text -->junk\n more<!-- End of picture text -->\n# \n", "\n## References\n[1] a"),
    ("Erratum 3 March 2021. See full text.\n<br><br>\n", "\n**Table 2** of values\nlast"),
    ("arXiv: 2101.01234v1\n\n\n\n", "\n3. Acknowledgments\nthanks"),
    ("DOI: 10.1000/182abcdefgh\n", "\nAppendix A\nx"),
)
_FRAMED = "framed AS (SELECT doc_id, {0}[CAST(doc_id % 6 + 1 AS INTEGER)] || text || {1}[CAST(doc_id % 6 + 1 AS INTEGER)] AS text FROM documents)".format(
    *("[" + ", ".join(quoted(f[i]) for f in _FRAMES) + "]" for i in (0, 1))
)


def _framed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id") % len(_FRAMES)
    return docs.select("doc_id", F.concat(pick(tuple(f[0] for f in _FRAMES), i), F.col("text"), pick(tuple(f[1] for f in _FRAMES), i)).alias("text"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_X = _STRIP.format("x")


def _sql_until(cut: str) -> str:
    return f"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM framed),
cut AS (SELECT doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: regexp_matches({_X}, {quoted(cut)})), true), 0) AS at_ FROM lines),
kept AS (SELECT doc_id, CASE WHEN at_ > 0 THEN ls[1:at_ - 1] ELSE ls END AS ls FROM cut)"""


_COLLAPSED = r"regexp_replace(array_to_string({}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query("clean_text_a", f"WITH {_FRAMED}, {_sql_until(v.CUT_A)} SELECT doc_id, " + _STRIP.format(_COLLAPSED.format(f"list_filter(ls, lambda x: NOT regexp_matches({_X}, {quoted(v.SKIP_A)}) AND {_X} <> '')")) + " AS text FROM kept")
def clean_text_a(spark, sf_dir):
    return _framed(spark, sf_dir).select("doc_id", t.clean_plain(F.col("text")).alias("text"))


@query("clean_text_b", f"WITH {_FRAMED}, {_sql_until(v.CUT_B)} SELECT doc_id, " + _STRIP.format(_COLLAPSED.format(f"list_transform(list_filter(ls, lambda x: {_X} = '' OR NOT regexp_matches({_X}, {quoted(v.SKIP_B)})), lambda x: CASE WHEN {_X} = '' THEN '' ELSE x END)")) + " AS text FROM kept")
def clean_text_b(spark, sf_dir):
    return _framed(spark, sf_dir).select("doc_id", t.clean_extracted(F.col("text")).alias("text"))


@query("clean_markdown", rf"""WITH {_FRAMED},
a AS (SELECT doc_id, regexp_replace(text, '(?s)<!-- Start of picture text -->.*?<!-- End of picture text -->', '', 'g') AS x FROM framed),
b AS (SELECT doc_id, regexp_replace(x, '(?m)^\s*(\w+\s*)?(<br>\s*)+$', '', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(x, {quoted(v.CORRECTION)}, '', 'g') AS x FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?m)^#{{1,4}}\s*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM c),
e AS (SELECT doc_id, string_split(x, chr(10)) AS ls FROM d),
f AS (SELECT doc_id, ls, coalesce(list_position(list_transform(ls, lambda x: regexp_matches({_X}, {quoted(v.CUT_HEADING)}) AND length({_X}) < 80 AND regexp_matches({_X}, '(?i)references|acknowledg')), true), 0) AS at_ FROM e)
SELECT doc_id, {_STRIP.format(f"regexp_replace(array_to_string(CASE WHEN at_ > 0 THEN ls[1:at_ - 1] ELSE ls END, chr(10)), {quoted(v.CAPTION)}, '', 'g')")} AS text FROM f""")
def clean_markdown(spark, sf_dir):
    return _framed(spark, sf_dir).select("doc_id", t.clean_markdown(F.col("text")).alias("text"))


@query("chunk_fixed_500_100", """WITH starts AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)))) AS idx FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(idx AS BIGINT) AS idx, substring(text, CAST(idx * 400 + 1 AS INTEGER), 500) AS content FROM starts""")
def chunk_fixed_500_100(spark, sf_dir):
    return chunking.fixed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("idx").cast("long").alias("idx"), "content")


@query("chunk_pack_2000")
def chunk_pack_2000(spark, sf_dir):
    return chunking.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return chunking.recursive(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("paragraph_repair")
def paragraph_repair(spark, sf_dir):
    return chunking.repaired(_framed(spark, sf_dir))


@query("chunk_quality", f"""WITH chunks AS (SELECT source, length(text) AS n, lower(trim(substring(text, 1, 60))) AS head, lower(substring(text, 1, 100)) AS start_ FROM documents),
q AS (SELECT source, count(*) AS n_chunks, CAST(floor(avg(n)) AS BIGINT) AS avg_len, min(n) AS min_len, max(n) AS max_len,
  CAST(sum(CASE WHEN n > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS too_long, CAST(sum(CASE WHEN n < 300 THEN 1 ELSE 0 END) AS BIGINT) AS too_short,
  count(*) - count(DISTINCT head) AS repeated_heads, string_agg(start_, chr(1)) AS starts FROM chunks GROUP BY source)
SELECT * EXCLUDE (starts), array_to_string(list_filter({sql_list(v.SECTIONS)}, lambda w: contains(starts, w)), ',') AS sections,
  coalesce(nullif(concat_ws('; ', CASE WHEN too_long > 0 THEN too_long || ' chunks exceed 2000 chars' END, CASE WHEN too_short > 0 THEN too_short || ' chunks below 300 chars' END, CASE WHEN repeated_heads > 0 THEN repeated_heads || ' potential duplicate chunks' END), ''), 'None') AS issues FROM q""")
def chunk_quality(spark, sf_dir):
    out = chunking.quality(table(spark, sf_dir, "documents"), "source", "text")
    return out.withColumns({"sections": F.array_join("sections", ","), "issues": F.array_join("issues", "; ")})


@query("printable_text", r"SELECT doc_id, length(regexp_replace(text || chr(7) || 'x', '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')) AS n, right(regexp_replace(text || chr(7) || 'x', '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), 2) AS tail FROM documents")
def printable_text(spark, sf_dir):
    clean = t.printable(F.concat("text", F.lit("\x07x")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.substring(clean, -2, 2).alias("tail"))



@query("html_links", r"""WITH found AS (SELECT page_id, regexp_extract(html, 'url\s*:\s*[''"](/[^''"]+\.pdf)[''"]', 1) AS script,
  regexp_extract(html, '(?i)<(iframe|embed|object)[^>]*\s(src|data)="([^"]*(\.pdf|storage)[^"]*)"', 3) AS framed,
  regexp_extract(html, '(?i)<a\s[^>]*href="([^"]*\.pdf[^"]*)"', 1) AS anchor, regexp_extract(html, 'https?://[^"''\s]+\.pdf') AS bare,
  regexp_extract(html, 'location\.href\s*=\s*[''"]([^''"]+\.pdf[^''"]*)[''"]', 1) AS click,
  regexp_extract_all(html, '<a\s[^>]*href="([^"]+)"', 1) AS hrefs FROM pages)
SELECT page_id, coalesce(nullif(script, ''), nullif(framed, ''), nullif(anchor, ''), nullif(bare, ''), nullif(click, '')) AS document, CAST(len(hrefs) AS BIGINT) AS n_links, hrefs[1] AS first_link FROM found""")
def html_links(spark, sf_dir):
    return chunking.links(table(spark, sf_dir, "pages"), "page_id", "html")


# Probing phrases before each turn's text, so that all rules of the classifiers occur.
_PHRASES = (
    "What is", "Compare A vs B:", "Give me an overview of", "which doping and synthesis", "thanks, got it", "find recent literature on stability",
    "how much is the thickness", "how to choose a method as a table", "没有数据吗", "not what i meant, list", "什么是", "对比 效率 表格", "tell me about the mechanism of", "pros and cons, versus",
)
_TURNS = f"turns AS (SELECT conv_id, turn, role, {sql_list(_PHRASES)}[CAST((conv_id + turn) % {len(_PHRASES)} + 1 AS INTEGER)] || ' ' || text AS q FROM conversations)"


def _turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", F.concat(pick(_PHRASES, (F.col("conv_id") + F.col("turn")) % len(_PHRASES)), F.lit(" "), "text").alias("q"))


def _sql_hits(words, text="lower(q)"):
    return f"len(list_filter({sql_list([w.lower() for w in words])}, lambda w: contains({text}, w)))"


def _sql_counts(words):
    short = [w for w in words if w.isascii() and len(w) <= 4]
    rest = [w for w in words if w not in short]
    return " + ".join([_sql_hits(rest), *(rf"CAST(regexp_matches(lower(q), '\b{w}\b') AS INTEGER)" for w in short)])


@query("review_classify", f"WITH {PAPERS} SELECT doc_id, CASE WHEN {_sql_hits(v.REVIEW, chr(108) + 'ower(p)')} > 0 THEN 'review' ELSE 'experimental' END AS paper_type FROM (SELECT doc_id, venue || ' ' || title || ' ' || source AS p FROM papers)")
def review_classify(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", c.paper_type(F.col("source"), F.col("venue"), F.col("title")).alias("paper_type"))


@query("question_classify", f"WITH {_TURNS} SELECT conv_id, turn, CASE WHEN {_sql_counts(v.SPECIFIC)} + {_sql_counts(v.STRONG_SPECIFIC)} > {_sql_counts(v.BROAD)} THEN 'specific' ELSE 'broad' END AS kind FROM turns")
def question_classify(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", c.question_type(F.col("q")).alias("kind"))


@query("intent_classify", f"""WITH {_TURNS}, counted AS (SELECT *, {_sql_hits(v.CHAT)} AS chat, {_sql_hits(v.RESEARCH)} AS research, length(q) < 50 AS short_ FROM turns)
SELECT conv_id, turn, CASE WHEN short_ AND research = 0 THEN 'chat' WHEN turn >= 2 AND conv_id % 2 = 0 AND chat = 0 THEN 'research' WHEN research > chat THEN 'research' WHEN chat > research THEN 'chat'
  WHEN short_ AND (contains(lower(q), 'what is') OR contains(lower(q), '什么是')) THEN 'chat' WHEN research > 0 THEN 'research' WHEN short_ THEN 'chat' ELSE 'research' END AS intent FROM counted""")
def intent_classify(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", c.intent(F.col("q"), F.col("turn") >= 2, F.col("conv_id") % 2 == 0).alias("intent"))


@query("style_classify", f"""WITH {_TURNS}, counted AS (SELECT *, {_sql_hits(v.DATA_LOOKUP)} AS data, {_sql_hits(v.HOW_TO)} AS how, {_sql_hits(v.COMPARE)} AS compare FROM turns)
SELECT conv_id, turn, CASE WHEN greatest(data, how, compare) = 0 THEN 'overview' WHEN data >= how AND data >= compare THEN 'data_lookup' WHEN how >= compare THEN 'how_to' ELSE 'compare' END AS style,
  CASE {" ".join(f"WHEN contains(lower(q), {quoted(w)}) THEN {quoted(k)}" for w, k in v.FORMATS)} END AS format,
  {_sql_hits(v.FRUSTRATION)} > 0 OR (contains(q, '没有') AND (contains(q, '吗') OR contains(q, '？') OR contains(q, '?'))) AS dissatisfied FROM counted""")
def style_classify(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", c.response_style(F.col("q")).alias("s")).select("conv_id", "turn", "s.*")


_KW = "list_distinct(regexp_extract_all(lower({}), '[a-zA-Z]{{3,}}|[\\x{{4e00}}-\\x{{9fff}}]+'))"
_OVERLAP = "CASE WHEN len(a) > 0 AND len(b) > 0 THEN CAST(len(list_intersect(a, b)) AS DOUBLE) / least(len(a), len(b)) ELSE 0 END"


@query("keyword_overlap", f"""WITH pairs AS (SELECT u.conv_id, u.turn, {_KW.format("u.text")} AS a, {_KW.format("s.text")} AS b FROM conversations u JOIN conversations s ON u.conv_id = s.conv_id AND s.turn = u.turn + 1 WHERE u.role = 'user' AND s.role = 'assistant')
SELECT conv_id, turn, round({_OVERLAP}, 6) AS overlap FROM pairs""")
def keyword_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    u, s = rows.where("role = 'user'").alias("u"), rows.where("role = 'assistant'").alias("s")
    both = u.join(s, (F.col("u.conv_id") == F.col("s.conv_id")) & (F.col("s.turn") == F.col("u.turn") + 1))
    return both.select("u.conv_id", "u.turn", F.round(t.keyword_overlap(F.col("u.text"), F.col("s.text")), 6).alias("overlap"))


@query("topic_drift", f"""WITH asked AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS last_ FROM conversations WHERE role = 'user'),
pairs AS (SELECT conv_id, turn, last_, {_KW.format("text")} AS a, {_KW.format("coalesce(last_, '')")} AS b FROM asked)
SELECT conv_id, turn, last_ IS NOT NULL AND {_OVERLAP} < 0.1 AS drift FROM pairs""")
def topic_drift(spark, sf_dir):
    from pyspark.sql import Window

    asked = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("last", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return asked.select("conv_id", "turn", (F.col("last").isNotNull() & (t.keyword_overlap(F.col("text"), F.coalesce("last", F.lit(""))) < 0.1)).alias("drift"))
