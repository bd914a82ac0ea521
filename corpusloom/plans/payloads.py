"""Queries of service payloads, names of files, session verbs and agents' bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import answers, identity, vocabulary
from corpusloom.operators import sessions as s
from corpusloom.operators import upkeep as u
from corpusloom.plans.standins import PAPERS, papers, pick, quoted, sql_list
from corpusloom.registry import query
from corpusloom.session import table
from corpusloom.sources import payloads, records

_PLAIN = r"regexp_replace({}, '[\x00-\x1f\x7f-\x9f\s]+', ' ', 'g')"


def _plain(column):
    return F.regexp_replace(column, r"[\x00-\x1f\x7f-\x9f\s]+", " ")


def _escaped(column):
    return F.replace(F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("atom_entries", f"""WITH {PAPERS}, p AS (SELECT *, trim({_PLAIN.format("text")}) AS t FROM papers WHERE text IS NOT NULL)
SELECT doc_id, t || ' and more' AS title, t AS summary, CAST(year AS VARCHAR) || '-01-02' AS published, source || ', ' || lang AS authors, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'http://arxiv.org/pdf/' || doc_id END AS pdf_url,
  CAST(doc_id AS VARCHAR) || 'v1' AS arxiv_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS category, CASE WHEN doc_id % 4 = 0 THEN '' ELSE trim(venue) END AS journal_ref FROM p""")
def atom_entries(spark, sf_dir):
    """Documents as entries of feeds, read back."""
    i, t = F.col("doc_id").cast("string"), _escaped(F.trim(_plain(F.col("text"))))
    entry = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/'), i, F.lit("v1</id><title>\n "), t, F.lit("\nand more</title><summary>"), t, F.lit("</summary><published>"), F.col("year").cast("string"), F.lit("-01-02T00:00:00Z</published>"),
        F.lit("<author><name>"), "source", F.lit("</name></author><author><name> "), "lang", F.lit(' </name></author><link title="doi" href="x"/>'), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit('<link title="pdf" href="http://arxiv.org/pdf/'), i, F.lit('"/>'))),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit('<arxiv:primary_category term="'), "lang", F.lit('"/>'))), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("<arxiv:journal_ref>"), _escaped(F.col("venue")), F.lit("</arxiv:journal_ref>"))), F.lit("</entry></feed>"),
    )
    rows = payloads.atom_entries(papers(spark, sf_dir).where("text is not null").select("doc_id", entry.alias("payload")))
    return rows.select("doc_id", "title", "summary", "published", F.array_join("authors", ", ").alias("authors"), "pdf_url", "arxiv_id", "category", "journal_ref")


@query("index_items", f"""WITH {PAPERS}, p AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN year WHEN doc_id % 3 = 1 THEN year - 1 ELSE 0 END AS y FROM papers)
SELECT doc_id, doi, coalesce(title, '') AS title, CAST(y AS INTEGER) AS year, citations AS cited, CASE WHEN doc_id % 2 = 0 THEN 'A. ' ELSE '' END || source AS authors, substring(coalesce(text, ''), 1, 500) AS abstract,
  CASE WHEN doc_id % 2 = 0 THEN venue ELSE 'press ' || lang END AS venue FROM p WHERE doi IS NOT NULL AND citations >= CASE WHEN y >= 2025 THEN 0 ELSE 10 END AND NOT (doc_id % 2 = 0 AND venue = '')""")
def index_items(spark, sf_dir):
    """Documents as the answers of a journal index, read back."""
    i, date = F.col("doc_id"), lambda y: F.struct(F.array(F.array(y)).alias("date-parts"))
    item = F.struct(
        F.col("doi").alias("DOI"), F.array("title").alias("title"), F.col("citations").alias("is-referenced-by-count"), F.when(i % 3 == 0, date(F.col("year"))).alias("published-print"), F.when(i % 3 == 1, date(F.col("year") - 1)).when(i % 3 == 0, date(F.lit(1999))).alias("published-online"),
        F.array(F.struct(F.when(i % 2 == 0, "A.").alias("given"), F.col("source").alias("family")), F.struct(F.lit("nobody").alias("given"), F.lit(None).cast("string").alias("family"))).alias("author"), F.col("text").alias("abstract"),
    )
    answer = F.to_json(F.struct(F.struct(F.array(item).alias("items"), F.when(i % 2 == 0, F.array("venue")).alias("container-title"), F.when(i % 2 == 1, F.concat(F.lit("press "), "lang")).alias("publisher")).alias("message")))
    rows = papers(spark, sf_dir).select("doc_id", answer.alias("payload"))
    named = rows.select("doc_id", payloads.venue_of(F.col("payload")).alias("venue")).where("venue is not null")
    found = payloads.index_items(rows, least=10).select("doc_id", "doi", "title", "year", "cited", F.array_join("authors", ",").alias("authors"), "abstract")
    return found.join(named, "doc_id")


@query("paper_details", f"""WITH {PAPERS} SELECT doc_id, 'p' || doc_id AS "paperId", coalesce(replace(title, chr(10), ' '), '') AS title, substring(coalesce(text, ''), 1, 1200) AS abstract, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS tldr, source AS authors, year,
  citations AS "citationCount", coalesce(doi, '') AS doi, lang AS "fieldsOfStudy" FROM papers WHERE doc_id % 7 <> 0""")
def paper_details(spark, sf_dir):
    i = F.col("doc_id")
    answer = F.to_json(F.struct(
        F.when(i % 7 != 0, F.concat(F.lit("p"), i.cast("string"))).alias("paperId"), "title", F.col("text").alias("abstract"), F.when(i % 2 == 0, F.struct(F.col("lang").alias("text"))).alias("tldr"), F.array(F.struct(F.col("source").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"), "year",
        F.col("citations").alias("citationCount"), F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.array("lang").alias("fieldsOfStudy"),
    ))
    rows = payloads.paper_details(papers(spark, sf_dir).select("doc_id", answer.alias("payload")))
    return rows.select("doc_id", "paperId", "title", "abstract", "tldr", F.array_join("authors", ",").alias("authors"), "year", "citationCount", "doi", F.array_join("fieldsOfStudy", ",").alias("fieldsOfStudy"))


@query("device_rows", f"""WITH {PAPERS} SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'N/A' ELSE CAST(citations AS VARCHAR) END AS pce, CASE WHEN doc_id % 3 = 0 THEN venue ELSE 'N/A' END AS composition, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS stability
FROM papers WHERE contains(lower('PCE=' || CASE WHEN doc_id % 4 = 3 THEN 'N/A' ELSE CAST(citations AS VARCHAR) END || ' Voc=N/A Jsc=N/A FF=N/A stability=' || CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END), '1')""")
def device_rows(spark, sf_dir):
    i = F.col("doc_id")
    named = F.create_map(
        pick(("pce", "efficiency", "PCE", "other"), i % 4), F.col("citations").cast("string"), F.when(i % 3 == 0, "composition").otherwise("unknown"), F.col("venue"), F.when(i % 2 == 0, "stability_test").otherwise("stability"), F.when(i % 2 == 0, F.col("source")).otherwise(F.col("lang")),
    )
    return payloads.devices(papers(spark, sf_dir).select("doc_id", F.to_json(named).alias("payload")), holding="1").select("doc_id", "pce", "composition", "stability")


_NAME = "CASE doc_id % 5 WHEN 0 THEN 'Nature_2021_s' || doc_id || '.pdf' WHEN 1 THEN 'Adv_Mater_' || replace(doi, '/', '_') || '.pdf' WHEN 2 THEN replace(doi, '/', '_') || '.pdf' WHEN 3 THEN 's2:p' || doc_id ELSE 'NatEnergy_' || source || '_' || year || '.pdf' END"


@query("file_names", f"""WITH {PAPERS}, n AS (SELECT doc_id, {_NAME} AS name, title FROM papers WHERE doi IS NOT NULL)
SELECT doc_id, coalesce(nullif(replace(regexp_replace(replace(name, '.pdf', ''), '(^|_)10\\.\\d.*$', ''), '_', ' '), ''), 'Unknown') AS journal,
  CASE WHEN starts_with(name, 's2:') THEN NULL WHEN contains(name, '_10.') THEN substring(name, instr(name, '_10.') + 1) ELSE name END AS doi_part, substring(md5(coalesce(title, '')), 1, 16) AS fallback FROM n""")
def file_names(spark, sf_dir):
    name = F.expr(_NAME)
    rows = papers(spark, sf_dir).where("doi is not null").select("doc_id", name.alias("name"), "title")
    return rows.select("doc_id", identity.journal_from_name(F.col("name")).alias("journal"), identity.doi_in_source(F.col("name")).alias("doi_part"), identity.fallback_name(F.col("title")).alias("fallback"))


@query("journal_by_prefix", f"""WITH {PAPERS}, n AS (SELECT doc_id, {_NAME} AS name FROM papers WHERE doi IS NOT NULL)
SELECT doc_id, CASE WHEN starts_with(name, 'NatEnergy_') THEN 'Nature Energy' WHEN starts_with(name, 'Adv_Mater_') THEN 'Advanced Materials' WHEN starts_with(name, 'Adv_') THEN 'Advances' WHEN starts_with(name, 'Nature_') THEN 'Nature' END AS journal,
  CASE WHEN starts_with(name, 'NatEnergy_') THEN 2 WHEN starts_with(name, 'Adv_Mater_') THEN 5 WHEN starts_with(name, 'Adv_') THEN 6 WHEN starts_with(name, 'Nature_') THEN 1 ELSE 7 END AS journal_rank FROM n""")
def journal_by_prefix(spark, sf_dir):
    """Ranks by the beginnings of names, put into the records' nested metadata and read there."""
    keys = spark.createDataFrame([("Nature", "Nature", 1), ("NatEnergy", "Nature Energy", 2), ("Adv", "Advances", 6), ("Adv_Mater", "Advanced Materials", 5)], "key string, journal string, journal_rank int")
    rows = papers(spark, sf_dir).where("doi is not null").select("doc_id", F.expr(_NAME).alias("name"))
    ranked = s.journal_by_prefix(rows, keys, "name")
    nested = ranked.select("doc_id", F.struct("name", F.lit(0).alias("journal_rank")).alias("metadata"), "journal", F.col("journal_rank").alias("r")).withColumn("metadata", F.col("metadata").withField("journal_rank", F.col("r")).withField("journal", F.col("journal")))
    return nested.select("doc_id", "metadata.journal", "metadata.journal_rank")


_MESSAGE = "'File ID: `' || role || 'file_' || conv_id || '` and `short` `' || role || '-other_' || turn || '`' || chr(10) || 'Source: ' || role || '/x.pdf.' || chr(10) || text"


@query("message_files", f"""WITH m AS (SELECT conv_id, turn, {_MESSAGE} AS m FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, turn, list_transform(regexp_extract_all(m, '(?:Source:\\s*|File ID:\\s*`?)([\\w\\-./]+)', 1), lambda x: rtrim(x, '.')) AS p, regexp_extract_all(m, '(?:File ID:\\s*)?`([A-Za-z][A-Za-z0-9_\\-]{{8,}})`', 1) AS q FROM m)
SELECT conv_id, turn, array_to_string(list_filter(q, lambda x, i: list_position(q, x) = i), ',') AS files, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS papers FROM f""")
def message_files(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.expr(_MESSAGE.replace("chr(10)", "'\\n'")).alias("m"))
    return rows.select("conv_id", "turn", F.array_join(identity.file_ids(F.col("m")), ",").alias("files"), F.array_join(identity.listed_papers(F.col("m")), ",").alias("papers"))


_ANSWER = "CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || '{\"a\": \"' || role || '\"}' || chr(10) || '``` tail }' WHEN 1 THEN 'so: {\"a\": {\"b\": ' || turn || '}} done' WHEN 2 THEN 'none' ELSE '```' || chr(10) || role || '{' || conv_id || '}```' END"


@query("json_in_answers", f"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS t FROM conversations)
SELECT conv_id, turn, nullif(regexp_extract(CASE WHEN starts_with(t, '```') AND regexp_extract(t, '(?s)^```[^\\n]*\\n(.*)```', 1) <> '' THEN regexp_extract(t, '(?s)^```[^\\n]*\\n(.*)```', 1) ELSE t END, '(?s)\\{{.*\\}}'), '') AS json FROM a""")
def json_in_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ANSWER.replace("chr(10)", "'\\n'")).alias("t"))
    return rows.select("conv_id", "turn", answers.json_in(F.col("t")).alias("json"))


# What became of each conversation: made, filled, renamed, some deleted and filled once more.
_OPS = """ops AS (SELECT conv_id AS sid, CAST(turn * 10 AS BIGINT) AS seq, 'append' AS verb, role, text FROM conversations
UNION ALL SELECT DISTINCT conv_id, -1, 'create', NULL, 'session ' || conv_id FROM conversations WHERE conv_id % 3 = 0
UNION ALL SELECT DISTINCT conv_id, 15, 'rename', NULL, CASE WHEN conv_id % 10 = 0 THEN '  ' ELSE '  named ' || conv_id || ' ' END FROM conversations WHERE conv_id % 5 = 0
UNION ALL SELECT DISTINCT conv_id, 25, 'delete', NULL, NULL FROM conversations WHERE conv_id % 7 = 0
UNION ALL SELECT DISTINCT conv_id, -5, 'rename', NULL, 'too early' FROM conversations WHERE conv_id % 11 = 0)"""


@query("session_verbs", f"""WITH {_OPS}, g AS (SELECT *, max(CASE WHEN verb = 'delete' THEN seq END) OVER (PARTITION BY sid) AS gone FROM ops),
l AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY seq) AS k, sum(CASE WHEN verb = 'append' AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY seq) AS users, max(CASE WHEN verb IN ('create', 'append') THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY seq) AS there FROM g WHERE gone IS NULL OR seq > gone),
t AS (SELECT *, CASE WHEN verb = 'create' THEN coalesce(text, '') WHEN verb = 'append' AND role = 'user' AND users = 1 THEN CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '......' ELSE coalesce(text, '') END
  WHEN verb = 'append' AND k = 1 THEN '' WHEN verb = 'rename' AND there = 1 AND trim(text) <> '' THEN substring(trim(text), 1, 60) END AS title FROM l WHERE there = 1)
SELECT sid, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS title, count(*) FILTER (WHERE verb = 'append') AS n_messages, min(seq) AS created, row_number() OVER (ORDER BY min(seq) DESC, sid DESC) AS recent FROM t GROUP BY sid""")
def session_verbs(spark, sf_dir):
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations_of_sessions")
    operations = spark.sql("WITH " + _OPS.replace("FROM conversations", "FROM conversations_of_sessions") + " SELECT * FROM ops")
    from corpusloom.operators.ranking import numbered

    states = s.session_states(operations)
    placed = numbered(states, [F.col("created").desc(), F.col("sid").desc()], "recent")
    return placed.select("sid", "title", "n_messages", "created", (F.col("recent") + 1).alias("recent"))


@query("active_tasks", """WITH t AS (SELECT user_id AS sid, event_id AS task_id, ts AS at_, event_type IN ('purchase', 'error') AS done, event_type = 'error' AS error FROM events), n AS (SELECT max(ts) AS now FROM events)
SELECT sid, count(*) AS n, count(*) FILTER (WHERE NOT done) AS running, string_agg(CAST(task_id AS VARCHAR) || ':' || CAST(done AS VARCHAR) || ':' || CAST(error AS VARCHAR), ',' ORDER BY task_id) AS tasks FROM t CROSS JOIN n WHERE NOT done OR now - at_ <= INTERVAL 3600 SECOND GROUP BY sid""")
def active_tasks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind, at = F.col("event_type"), F.col("ts").cast("timestamp")
    now = events.agg(F.max(at).alias("now"))
    tasks = events.select(F.col("user_id").alias("sid"), F.col("event_id").alias("task_id"), at.alias("at"), kind.isin("purchase", "error").alias("done"), (kind == "error").alias("error")).crossJoin(F.broadcast(now))
    return s.tasks_by_session(tasks, F.col("now"), keep=3600)


@query("stream_replay", "WITH w AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t, (conv_id * 37) % 400 AS seen FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN seen < length(t) THEN substring(t, seen + 1) ELSE '' END AS rest, greatest(seen, length(t)) AS upto FROM w")
def stream_replay(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    offsets = rows.select("conv_id").distinct().withColumn("seen", ((F.col("conv_id") * 37) % 400).cast("int"))
    return s.replayed(rows, offsets, "conv_id", "turn", "text").withColumn("upto", F.col("upto").cast("long"))


@query("failure_streaks", """WITH r AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events), g AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM r),
n AS (SELECT user_id, run, sum(f) AS n FROM g GROUP BY user_id, run) SELECT user_id, CAST(max(n) AS BIGINT) AS longest, CAST(arg_max(n, run) AS BIGINT) AS current FROM n GROUP BY user_id""")
def failure_streaks(spark, sf_dir):
    return s.failure_streaks(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error")


_TOOL = sql_list([t for tools in s.STATE_TOOLS.values() for t in tools] + ["run_gaussian"])


@query("allowed_tools", f"""WITH c AS (SELECT conv_id, turn, {_TOOL}[CAST(turn % 11 + 1 AS INTEGER)] AS tool, CASE conv_id % 3 WHEN 0 THEN 'retrieve' WHEN 1 THEN 'read' ELSE 'respond' END AS state FROM conversations)
SELECT conv_id, turn, tool, CASE state WHEN 'retrieve' THEN list_contains({sql_list(s.STATE_TOOLS["retrieve"])}, tool) WHEN 'read' THEN list_contains({sql_list(s.STATE_TOOLS["read"])}, tool) ELSE false END AS ok FROM c""")
def allowed_tools(spark, sf_dir):
    names = (*(t for tools in s.STATE_TOOLS.values() for t in tools), "run_gaussian")
    tool = pick(names, F.col("turn") % len(names))
    state = pick(("retrieve", "read", "respond"), F.col("conv_id") % 3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tool.alias("tool"), s.allowed(tool, state).alias("ok"))


@query("harvest_pace", f"WITH {PAPERS} SELECT source, CAST(floor(d * 100 / n) AS BIGINT) AS percent, round(d / sec * 60, 4) AS per_minute, CASE WHEN d > 0 THEN round((n - d) / (d / sec * 60), 4) ELSE 0.0 END AS minutes_left FROM (SELECT source, CAST(count(*) FILTER (WHERE tier = 1) AS DOUBLE) AS d, count(*) AS n, max(year) AS sec FROM papers GROUP BY source)")
def harvest_pace(spark, sf_dir):
    rows = papers(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("tier") == 1).alias("d"), F.count("*").alias("n"), F.max("year").alias("sec"))
    return rows.select("source", u.pace(F.col("d"), F.col("n"), F.col("sec")).alias("p")).select("source", "p.*")


@query("files_to_sync", f"""WITH {PAPERS}, l AS (SELECT DISTINCT {_NAME} AS name FROM papers WHERE doi IS NOT NULL), y AS (SELECT name, coalesce(nullif(regexp_extract(name, '(20\\d{{2}})', 1), ''), '2026') AS year FROM l)
SELECT name, year, '07' AS month FROM y WHERE NOT (length(name) % 2 = 0)""")
def files_to_sync(spark, sf_dir):
    listed = papers(spark, sf_dir).where("doi is not null").select(F.expr(_NAME).alias("name"))
    there = records.file_away(listed, listed.limit(0).selectExpr("name", "name AS year", "name AS month"), "07", "2026").where("length(name) % 2 = 0")
    return records.file_away(listed, there, "07", "2026")


@query("largest_files", "SELECT doc_id AS name, n_chars AS size, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents")
def largest_files(spark, sf_dir):
    """Files in order of size, the largest first, with their places."""
    from corpusloom.operators.ranking import numbered

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("n_chars").alias("size"))
    return numbered(rows, [F.col("size").desc(), F.col("name")], "place").select("name", "size", (F.col("place") + 1).alias("place"))


_PAIRS = [("Cs", 12), ("Cs", 6), ("Pb", 6), ("Pb", 12), ("MA", 11), ("I", 2), ("Xx", 6)]


@query("ionic_radii", "WITH r AS (SELECT l_orderkey % 7 AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT k, n, [1.88, 1.88, 1.19, 1.19, 2.17, 2.20, NULL][CAST(k + 1 AS INTEGER)] AS radius FROM r")
def ionic_radii(spark, sf_dir):
    """Radii by ion and coordination number, for keys of orders that stand for ions."""
    from corpusloom.operators.materials import ionic_radius

    k = F.col("k")
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 7).alias("k")).agg(F.count("*").alias("n"))
    number = F.element_at(F.array(*(F.lit(n) for _, n in _PAIRS)), (k + 1).cast("int"))
    return rows.select("k", "n", ionic_radius(pick(tuple(x for x, _ in _PAIRS), k), number).alias("radius"))


_URLS = "CASE split_part(publisher_doi, '/', 1) " + " ".join(f"WHEN {quoted(p)} THEN replace(replace({quoted(identity.DOCUMENT_URLS[n])}, '{{doi}}', publisher_doi), '{{rest}}', substring(publisher_doi, instr(publisher_doi, '/') + 1))" for p, n in vocabulary.PUBLISHERS.items() if n in identity.DOCUMENT_URLS) + " END"


@query("document_urls", f"WITH {PAPERS} SELECT doc_id, {_URLS} AS url FROM papers WHERE publisher_doi IS NOT NULL")
def document_urls(spark, sf_dir):
    return papers(spark, sf_dir).where("publisher_doi is not null").select("doc_id", identity.guess_url(F.col("publisher_doi")).alias("url"))


@query("markup_check", f"SELECT conv_id, turn, len(list_filter({sql_list(vocabulary.MARKUP)}, lambda w: contains(CASE turn % 3 WHEN 0 THEN text || '<invoke name=\"x\">' WHEN 1 THEN text ELSE '<tool_call>' || text END, w))) > 0 AS dirty FROM conversations")
def markup_check(spark, sf_dir):
    t = F.col("turn") % 3
    said = F.when(t == 0, F.concat("text", F.lit('<invoke name="x">'))).when(t == 1, F.col("text")).otherwise(F.concat(F.lit("<tool_call>"), "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.has_markup(said).alias("dirty"))


@query("material_entries", """SELECT p_partkey, CAST(i + 1 AS INTEGER) AS place, 'mp-' || p_partkey || '-' || i AS material_id, p_brand AS formula, CASE WHEN i % 3 = 0 THEN 0.0 ELSE round(p_retailprice / 997.1 + i, 3) END AS band_gap_eV,
  round(-p_retailprice / 7003.3, 4) AS formation_energy_eV_per_atom, CASE WHEN i % 2 = 0 THEN 'Pm-3m' ELSE 'N/A' END AS crystal_system FROM part, (SELECT unnest(range(0, 10)) AS i) WHERE i < p_size % 14""")
def material_entries(spark, sf_dir):
    """Parts as answers of a materials database with up to 13 entries, ten of which count."""
    n, price = F.col("p_size") % 14, F.col("p_retailprice").cast("double")

    def entry(i):
        gap = F.when(i % 3 != 0, price / 997.1 + i)
        return F.struct(
            F.concat(F.lit("mp-"), F.col("p_partkey").cast("string"), F.lit("-"), i.cast("string")).alias("entry_id"), F.col("p_brand").alias("reduced_formula"), F.when(i % 2 == 0, "Pm-3m").alias("spacegroup"),
            F.struct(gap.alias("band_gap"), (-price / 7003.3).alias("formation_energy_per_atom")).alias("data"),
        )

    made = F.when(n > 0, F.to_json(F.transform(F.sequence(F.lit(0), n - 1), entry))).otherwise('{"error": "none"}')
    return payloads.material_entries(table(spark, sf_dir, "part").select("p_partkey", made.alias("payload")))


@query("point_catalogue", """WITH p AS (SELECT doc_id, 'Nature_' || (doc_id % 23) AS a, 'x' || (doc_id % 31) AS b, text FROM documents WHERE doc_id % 9 <> 0),
s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN a ELSE b END AS source, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '/papers/' || (2000 + doc_id % 20) || '/f.pdf' END AS path, coalesce(text, '') AS text FROM p)
SELECT source, arg_min(path, doc_id) AS path, CASE WHEN starts_with(source, 'Nature') THEN 'Nature' ELSE 'Other' END AS journal,
  trim(replace(substring(coalesce(arg_min(text, doc_id) FILTER (WHERE length(text) > 20), ''), 1, 150), chr(10), ' ')) AS title_preview, count(*) AS chunk_count,
  TRY_CAST(regexp_extract(arg_min(path, doc_id), '/(\\d{4})/', 1) AS INTEGER) AS year FROM s GROUP BY source""")
def point_catalogue(spark, sf_dir):
    """Documents as points of a vector store, told by source."""
    i = F.col("doc_id")
    source = F.when(i % 9 == 0, "").when(i % 2 == 0, F.concat(F.lit("Nature_"), (i % 23).cast("string"))).otherwise(F.concat(F.lit("x"), (i % 31).cast("string")))
    path = F.when(i % 5 != 0, F.concat(F.lit("/papers/"), (2000 + i % 20).cast("string"), F.lit("/f.pdf")))
    point = F.to_json(F.struct(F.struct(F.col("text").alias("page_content"), F.struct(source.alias("source"), path.alias("path")).alias("metadata")).alias("payload")))
    return payloads.point_catalogue(table(spark, sf_dir, "documents").select(i.alias("point_id"), point.alias("point")), {"NatureEnergy": "Nature Energy", "Nature": "Nature"})
