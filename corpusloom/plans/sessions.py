"""Queries of sessions, pools, modes, acquisition and filing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import identity
from corpusloom.functions.answers import thinking_chain, without_markup
from corpusloom.operators import sessions as s
from corpusloom.plans.records import _PUB
from corpusloom.plans.standins import PAPERS, papers, pick, sql_list
from corpusloom.registry import query
from corpusloom.session import table

_NAMES = ("chat", "survey", "deep", "read", "compute", "auto", "bogus")
_MODE = "CASE WHEN name IN ('chat', 'survey', 'deep', 'read', 'compute') THEN name ELSE 'auto' END"


def _case(column: int) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return "CASE key " + " ".join(f"WHEN '{k}' THEN {quote(m[column])}" for k, m in s.MODES.items()) + " END"


@query("mode_lookup", f"SELECT conv_id, turn, key, {_case(0)} AS path, {_case(1)} AS searches, {_case(2)} AS reads, {_case(3)} AS papers, {_case(4)} AS cites, {_case(5)} AS searches_before, {_case(6)} AS prompt, {_case(7)} AS computes FROM (SELECT conv_id, turn, {_MODE} AS key FROM (SELECT conv_id, turn, {sql_list(_NAMES)}[CAST((conv_id + turn) % 7 + 1 AS INTEGER)] AS name FROM conversations))")
def mode_lookup(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", s.mode(pick(_NAMES, (F.col("conv_id") + F.col("turn")) % 7)).alias("m")).select("conv_id", "turn", "m.*")


@query("entry_state", f"""WITH m AS (SELECT conv_id, turn, {_case(0)} AS path, conv_id % 2 = 0 AS pool, turn >= 2 AS follow, CASE WHEN turn % 3 = 0 THEN 'chat' ELSE 'research' END AS intent FROM (SELECT conv_id, turn, {_MODE} AS key FROM (SELECT conv_id, turn, {sql_list(_NAMES)}[CAST((conv_id + turn) % 7 + 1 AS INTEGER)] AS name FROM conversations)))
SELECT conv_id, turn, CASE path WHEN 'direct' THEN 'respond' WHEN 'quick' THEN 'quick_read' WHEN 'full' THEN 'retrieve' WHEN 'flexible' THEN CASE WHEN intent = 'chat' AND NOT pool THEN 'respond' ELSE 'retrieve' END
  ELSE CASE WHEN follow AND pool AND intent <> 'chat' THEN 'deep_read' WHEN intent = 'chat' THEN 'respond' ELSE 'retrieve' END END AS state FROM m""")
def entry_state(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    path = s.mode(pick(_NAMES, (conv + turn) % 7))["path"]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", s.entry_state(path, F.when(turn % 3 == 0, "chat").otherwise("research"), conv % 2 == 0, turn >= 2).alias("state"))


@query("result_coalesce", f"""WITH {PAPERS} SELECT source, title, CASE WHEN doc_id % 3 = 1 THEN nullif(venue, '') END AS journal, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE year END AS year, substring(CASE WHEN doc_id % 2 = 0 THEN text ELSE title END, 1, 500) AS preview FROM papers""")
def result_coalesce(spark, sf_dir):
    rows = papers(spark, sf_dir)
    i = F.col("doc_id")
    shaped = rows.select("source", "title", F.lit("").alias("journal_name"), F.when(i % 3 == 1, F.col("venue")).alias("venue"), F.when(i % 4 == 0, "").otherwise(F.col("year").cast("string")).alias("year"), F.when(i % 2 == 0, F.col("text")).otherwise("").alias("content"), F.col("title").alias("abstract"))
    return s.pool_record(shaped)


def _pools(spark, sf_dir):
    rows = papers(spark, sf_dir)
    session = (F.col("doc_id") % 5).alias("session_id")
    pool = rows.where("doc_id % 4 = 0").groupBy(session, "source").agg(F.min_by(F.struct(F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.col("title")).alias("title"), F.when(F.col("doc_id") % 8 == 4, F.col("year")).alias("year"), F.substring("text", 1, 500).alias("preview")), "doc_id").alias("_"))
    pool = pool.select("session_id", "source", "_.*", F.lit(False).alias("is_read"), F.lit(True).alias("has_fulltext"))
    found = rows.where("doc_id % 4 <> 0").select(session, "source", "title", "year", F.substring("text", 1, 500).alias("preview"), F.col("doc_id").alias("seq"))
    return pool, found


_POOLS = f"""{PAPERS},
pool AS (SELECT doc_id % 5 AS session_id, source, arg_min(CASE WHEN doc_id % 8 = 0 THEN '' ELSE title END, doc_id) AS title, min(doc_id) AS first_, arg_min(substring(text, 1, 500), doc_id) AS preview FROM papers WHERE doc_id % 4 = 0 GROUP BY 1, 2),
pool_y AS (SELECT p.*, CASE WHEN first_ % 8 = 4 THEN CAST(first_ % 18 + 2009 AS INTEGER) END AS year FROM pool p),
found AS (SELECT doc_id % 5 AS session_id, source, arg_min(title, doc_id) AS title, CAST(min(doc_id) % 18 + 2009 AS INTEGER) AS year, arg_min(substring(text, 1, 500), doc_id) AS preview FROM papers WHERE doc_id % 4 <> 0 GROUP BY 1, 2)"""


@query("pool_merge", f"""WITH {_POOLS} SELECT coalesce(p.session_id, f.session_id) AS session_id, coalesce(p.source, f.source) AS source, coalesce(nullif(p.title, ''), f.title) AS title, coalesce(p.year, f.year) AS year,
  CASE WHEN p.source IS NOT NULL THEN p.preview ELSE f.preview END AS preview, false AS is_read, true AS has_fulltext FROM pool_y p FULL OUTER JOIN found f ON p.session_id = f.session_id AND p.source = f.source""")
def pool_merge(spark, sf_dir):
    return s.merge_pool(*_pools(spark, sf_dir))


@query("pool_states", f"""WITH {_POOLS}, marked AS (SELECT session_id, source, CASE WHEN CAST(substring(source, 4) AS INTEGER) % 3 = 0 THEN true WHEN CAST(substring(source, 4) AS INTEGER) % 3 = 1 THEN false END AS ok FROM pool_y)
SELECT session_id, sum(CASE WHEN ok IS NULL THEN 1 ELSE 0 END)::BIGINT AS unread, sum(CASE WHEN ok IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS read_, sum(CASE WHEN ok = false THEN 1 ELSE 0 END)::BIGINT AS no_text FROM marked GROUP BY session_id""")
def pool_states(spark, sf_dir):
    pool, _ = _pools(spark, sf_dir)
    number = F.substring("source", 4, 9).cast("int")
    outcomes = pool.where(number % 3 < 2).select("session_id", "source", (number % 3 == 0).alias("ok"))
    marked = s.mark(pool, outcomes)
    return marked.groupBy("session_id").agg(F.count_if(~F.col("is_read")).alias("unread"), F.count_if(F.col("is_read")).alias("read_"), F.count_if(~F.col("has_fulltext")).alias("no_text"))


@query("read_outcome", "SELECT doc_id, n_chars >= 100 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 AS ok FROM documents")
def read_outcome(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", s.read_ok(F.col("n_chars"), F.when(i % 7 == 0, "timeout").otherwise(""), F.when(i % 5 == 0, "Document Not Found").otherwise("text")).alias("ok"))


@query("text_acquisition", f"""WITH {PAPERS}, r AS (SELECT doc_id, tier, doc_id % 2 = 0 AS f, CASE WHEN doc_id % 4 = 0 THEN text ELSE '' END AS e, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS raw FROM papers)
SELECT doc_id, CASE WHEN f AND length(e) > 300 THEN e WHEN tier = 1 THEN coalesce(raw, '') ELSE substring(coalesce(raw, ''), 1, 2000) END AS content, CASE WHEN f AND length(e) > 300 THEN 1 ELSE tier END AS tier,
  CASE WHEN f AND length(e) > 300 THEN 'extracted' WHEN tier = 1 AND NOT f THEN 'fallback_no_file' WHEN tier = 1 AND coalesce(raw, '') <> '' THEN 'fallback' WHEN tier = 1 THEN 'failed' ELSE 'abstract' END AS status FROM r""")
def text_acquisition(spark, sf_dir):
    i = F.col("doc_id")
    rows = papers(spark, sf_dir).select("doc_id", "tier", (i % 2 == 0).alias("has_file"), F.when(i % 4 == 0, F.col("text")).otherwise("").alias("extracted"), F.when(i % 3 != 0, F.col("text")).alias("content_raw"))
    return s.acquired(rows)


@query("context_compression", """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'system' ELSE role END AS role, text FROM conversations),
t AS (SELECT *, floor(sum(length(text)) OVER (PARTITION BY conv_id) / 4.0) AS tokens, min(CASE WHEN role = 'system' AND length(text) > 500 THEN turn END) OVER (PARTITION BY conv_id) AS first_ FROM m)
SELECT conv_id, turn, role, CASE WHEN tokens >= 500 AND turn = first_ THEN '[压缩] ' || split_part(text, chr(10), 1) || chr(10) || '  摘要: ' || replace(substring(text, 1, 300), chr(10), ' ') || '...' ELSE text END AS text FROM t""")
def context_compression(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 2 == 0, "system").otherwise(F.col("role")))
    return s.compressed(rows, most_tokens=500)


@query("source_validation", f"WITH {PAPERS}, asked AS (SELECT DISTINCT conv_id, 'src' || CAST((conv_id * 3 + turn) % 25 AS VARCHAR) AS source FROM conversations) SELECT conv_id, source, CASE WHEN source IN (SELECT source FROM papers WHERE tier = 1) THEN 'validated' ELSE 'supplementary' END AS kind FROM asked")
def source_validation(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("src"), ((F.col("conv_id") * 3 + F.col("turn")) % 25).cast("string")).alias("source"))
    return s.validated(asked, papers(spark, sf_dir).where("tier = 1"))


@query("session_export", "SELECT conv_id, string_agg(role || ':' || text, '' ORDER BY turn) AS text, count(*) AS n_parts FROM conversations GROUP BY conv_id")
def session_export(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), "text").alias("text"))
    return s.accumulated(rows, ("conv_id",), "turn", "text")


@query("thinking_chain", "WITH m AS (SELECT conv_id, turn, ['💭 ', '🔧 ', '', '⚠️ '][CAST(turn % 4 + 1 AS INTEGER)] || text AS t FROM conversations) SELECT conv_id, coalesce(string_agg(CASE WHEN turn % 4 <> 2 THEN trim(t) END, chr(10) || chr(10) ORDER BY turn), '') AS chain FROM m GROUP BY conv_id")
def thinking_chain_query(spark, sf_dir):
    marks = pick(("💭 ", "🔧 ", "", "⚠️ "), F.col("turn") % 4)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(marks, "text").alias("t"))
    parts = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]).alias("p"))
    return parts.select("conv_id", thinking_chain(F.col("p")).alias("chain"))


@query("markup_strip", r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace('<think>a</think> ' || text || '<tool_call>{x}' || chr(10) || '</tool_call><invoke name=\"y\">', '(?s)<tool_call>.*?</tool_call>', '', 'g'), '</?(tool_call|function|parameter|invoke|think)[^>]*>', '', 'g')) AS text FROM conversations".replace('\\"', '"'))
def markup_strip(spark, sf_dir):
    dressed = F.concat(F.lit("<think>a</think> "), "text", F.lit('<tool_call>{x}\n</tool_call><invoke name="y">'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", without_markup(dressed).alias("text"))


@query("filing_plan", f"""WITH {PAPERS}, f AS (SELECT replace(publisher_doi, '/', '_') || '.pdf' AS name, CASE WHEN doc_id % 4 = 0 THEN 'nature' ELSE {_PUB} END AS folder, {_PUB} AS right_ FROM papers WHERE publisher_doi IS NOT NULL),
d AS (SELECT DISTINCT * FROM f), w AS (SELECT d.*, (right_, name) IN (SELECT (folder, name) FROM f) AS taken FROM d WHERE folder <> right_)
SELECT name, folder || '/' || name AS source_path, right_ || '/' || CASE WHEN taken THEN replace(name, '.pdf', '_DUP.pdf') ELSE name END AS target_path, CASE WHEN taken THEN 'conflict' ELSE 'move' END AS action FROM w""")
def filing_plan(spark, sf_dir):
    right = identity.publisher(F.col("publisher_doi"))
    rows = papers(spark, sf_dir).where("publisher_doi is not null").select(identity.doi_to_filename(F.col("publisher_doi")).alias("name"), F.when(F.col("doc_id") % 4 == 0, "nature").otherwise(right).alias("folder"), right.alias("right_folder")).distinct()
    return s.filing_plan(rows, rows)


@query("citation_neighbours", f"""WITH {PAPERS}, e AS (SELECT DISTINCT doc_id AS src, (doc_id * k) // 7 AS dst FROM papers CROSS JOIN (SELECT unnest(range(1, 5)) AS k) WHERE doc_id % 5 = 0 UNION SELECT doc_id, doc_id // 2 FROM papers)
SELECT src, dst, citations, place FROM (SELECT src, dst, citations, row_number() OVER (PARTITION BY src ORDER BY citations DESC, dst) AS place FROM e JOIN papers ON dst = doc_id) WHERE place <= 3""")
def citation_neighbours(spark, sf_dir):
    rows = papers(spark, sf_dir)
    i = F.col("doc_id")
    five = rows.where("doc_id % 5 = 0").select(i.alias("src"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).select("src", F.floor(F.col("src") * F.col("k") / 7).alias("dst"))
    edges = five.unionByName(rows.select(i.alias("src"), F.floor(i / 2).alias("dst"))).distinct()
    return s.neighbours(edges, rows, n=3).select("src", "dst", "citations", F.col("place").cast("long").alias("place"))


@query("doi_check", f"WITH {PAPERS} SELECT doc_id, lower(doi) = lower(CASE WHEN doc_id % 6 = 1 THEN upper(doi) WHEN doc_id % 6 = 2 THEN '10.1/other' ELSE doi END) AS same FROM papers WHERE doi IS NOT NULL")
def doi_check(spark, sf_dir):
    i = F.col("doc_id")
    content = F.when(i % 6 == 1, F.upper("doi")).when(i % 6 == 2, "10.1/other").otherwise(F.col("doi"))
    return papers(spark, sf_dir).where("doi is not null").select("doc_id", (identity.normalize_doi(F.col("doi")) == identity.normalize_doi(content)).alias("same"))


@query("question_report", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY role")
def question_report(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("sessions"))


