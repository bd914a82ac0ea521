"""Queries of record curation and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import identity as i
from corpusloom.functions import text as t
from corpusloom.functions import vocabulary as v
from corpusloom.operators import curation as c
from corpusloom.plans.standins import PAPERS, papers, pick, quoted, sql_list
from corpusloom.registry import query
from corpusloom.session import table

_FORMS = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(x)}" for k, x in v.VENUE_FORMS.items()) + "}"
_VENUE = f"coalesce({_FORMS}[rtrim(lower(trim(venue)), '.')], trim(venue))"


@query("normalize_venue", f"WITH {PAPERS} SELECT doc_id, {_VENUE} AS venue FROM papers")
def normalize_venue(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", c.normalize_venue(F.col("venue")).alias("venue"))


@query("quality_filter", f"WITH {PAPERS} SELECT doc_id, citations, year, tier FROM papers WHERE citations >= 5 OR year >= 2026 OR list_contains({sql_list(v.GOOD_VENUES)}, {_VENUE})")
def quality_filter(spark, sf_dir):
    return papers(spark, sf_dir).where(c.is_good(F.col("citations"), F.col("year"), F.col("venue"))).select("doc_id", "citations", "year", "tier")


@query("doi_dedup", f"""WITH {PAPERS}, best AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(doi)) ORDER BY citations DESC, doc_id) AS r FROM papers WHERE doi IS NOT NULL)
SELECT doc_id, doi, citations FROM best WHERE r = 1 UNION ALL SELECT doc_id, doi, citations FROM papers WHERE doi IS NULL""")
def doi_dedup(spark, sf_dir):
    return c.one_per_identifier(papers(spark, sf_dir)).select("doc_id", "doi", "citations")


_TITLE = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("title_jaccard_pairs", f"""WITH named AS (SELECT doc_id AS id, {_TITLE.format("substring(text, 1, 80)")} AS t FROM documents),
same AS (SELECT t, min(id) AS rep FROM named WHERE length(t) > 0 GROUP BY t),
grams AS (SELECT rep, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, CAST(i AS INTEGER), 3))) AS g FROM same WHERE length(t) >= 3),
words AS (SELECT rep, len(g) AS m, unnest(g) AS w FROM grams),
shared AS (SELECT x.rep AS a, y.rep AS b, count(*) AS n, max(x.m) AS mx, max(y.m) AS my FROM words x JOIN words y ON x.w = y.w AND x.rep < y.rep GROUP BY x.rep, y.rep)
SELECT a, b, round(CAST(n AS DOUBLE) / (mx + my - n), 6) AS similarity FROM shared WHERE 100 * n >= 85 * (mx + my - n)
UNION ALL SELECT rep AS a, id AS b, 1.0 AS similarity FROM named JOIN same USING (t) WHERE id <> rep""")
def title_jaccard_pairs(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 80).alias("title"))
    return c.title_pairs(records, "doc_id", "title").withColumn("similarity", F.round("similarity", 6))


@query("title_dedup_greedy")
def title_dedup_greedy(spark, sf_dir):
    return c.greedy_titles(papers(spark, sf_dir), "doc_id", "title", "citations")


@query("name_similarity", """WITH names AS (SELECT p_name, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY p_name),
pairs AS (SELECT a.k AS a, b.k AS b, list_distinct(list_transform(range(1, length(a.p_name) - 1), lambda i: substring(lower(a.p_name), CAST(i AS INTEGER), 3))) AS x,
  list_distinct(list_transform(range(1, length(b.p_name) - 1), lambda i: substring(lower(b.p_name), CAST(i AS INTEGER), 3))) AS y FROM names a JOIN names b ON a.k < b.k AND split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1))
SELECT a, b, round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM pairs""")
def name_similarity(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    x, y = names.alias("x"), names.alias("y")
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    both = x.join(y, (first("x.p_name") == first("y.p_name")) & (F.col("x.k") < F.col("y.k")))
    return both.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.round(t.ngram_jaccard(F.lower("x.p_name"), F.lower("y.p_name")), 6).alias("similarity"))


@query("exact_dup_groups", "SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) AS n_sources FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("fingerprint"))
    return groups.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.countDistinct("source").alias("n_sources")).where("n > 1")


@query("curation_report", f"""WITH {PAPERS}, sets AS (SELECT 'tier' AS kind, CAST(tier AS VARCHAR) AS value, count(*) AS n FROM papers GROUP BY tier
UNION ALL SELECT 'venue', CASE WHEN venue = '' THEN '(unknown)' ELSE venue END, count(*) FROM papers GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM papers GROUP BY year)
SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS r FROM sets) WHERE kind <> 'venue' OR r <= 20""")
def curation_report(spark, sf_dir):
    return c.report(papers(spark, sf_dir))


@query("tier_split", f"WITH {PAPERS} SELECT tier, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(100.0 * count(*) / (SELECT count(*) FROM papers), 4) AS percent FROM papers GROUP BY tier")
def tier_split(spark, sf_dir):
    tiers = papers(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    total = tiers.agg(F.sum("n").alias("total"))
    return tiers.crossJoin(total).select("tier", "n", "chars", F.round(F.col("n") * 100.0 / F.nullif("total", F.lit(0)), 4).alias("percent"))


# Ranks of journals, in the order in which they are looked for.
RANKS = (
    ("Nature", 1), ("Science", 1), ("Nature Energy", 2), ("Nature Materials", 2), ("Joule", 2), ("Nature Photonics", 3), ("Nature Nanotechnology", 3), ("Matter", 3),
    ("Nature Communications", 4), ("Science Advances", 4), ("Chem", 4), ("ACS Energy Letters", 5), ("Advanced Materials", 5), ("Advanced Energy Materials", 5),
    ("Energy & Environmental Science", 5), ("Angewandte Chemie", 5), ("JACS", 5), ("Advanced Functional Materials", 6), ("Nano Energy", 6), ("ACS Nano", 6),
    ("Nano Letters", 6), ("Chemistry of Materials", 6), ("Solar RRL", 7), ("Small", 7), ("Advanced Science", 7), ("Journal of Materials Chemistry A", 7), ("ACS Applied Materials & Interfaces", 7),
)


@query("venue_first_key", f"WITH {PAPERS} SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(venue), {quoted(k.lower())}) THEN {r}" for k, r in RANKS) + " ELSE 8 END AS rank FROM papers")
def venue_first_key(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", c.by_first_key(F.col("venue"), RANKS, 8).alias("rank"))


_SAFE = r"coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60), ''), 'Unknown')"
_BRACKETS = r"regexp_replace(regexp_replace({}, '(?i)\s*\((?:" + "|".join(v.VENUE_PUBLISHERS) + r")[^)]*\)', '', 'g'), '(?i)\s*\((?:" + "|".join(v.VENUE_TOWNS) + r")[^)]*\)', '', 'g')"
_CLEAN = r"trim(regexp_replace(" + _BRACKETS.format(r"regexp_replace(replace(replace(replace(trim(venue), '&amp;', '&'), '&#38;', '&'), '&eacute;', 'é'), '\s*\(Print\)\s*', ' ', 'g')") + r", '\s+', ' ', 'g'))"
# The longest key that stands in a name as whole words, wherever it does.
_INSIDE = r"""SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY length(k) DESC, k DESC) AS r FROM {} JOIN ks ON contains(v, k) WHERE regexp_matches(v, '(^|[^\p{{L}}\p{{N}}])' || regexp_escape(k) || '([^\p{{L}}\p{{N}}]|$)')"""


@query("venue_longest_key", f"""WITH {PAPERS}, vs AS (SELECT DISTINCT venue AS id, lower({_CLEAN}) AS v FROM papers),
ks AS (SELECT lower(k) AS k, {_SAFE.format("k")} AS value FROM (SELECT unnest({sql_list(v.GOOD_VENUES)}) AS k)), met AS ({_INSIDE.format("vs")})
SELECT doc_id, coalesce(value, CASE WHEN trim(p.venue) = '' THEN 'Unknown' ELSE {_SAFE.format(_CLEAN.replace("venue", "p.venue"))} END) AS folder FROM papers p LEFT JOIN met m ON p.venue = m.id AND m.r = 1""")
def venue_longest_key(spark, sf_dir):
    rows = papers(spark, sf_dir)
    folder = F.coalesce("matched", F.when(F.trim("venue") == "", "Unknown").otherwise(c.safe_name(c.clean_venue(F.col("venue")))))
    return rows.join(c.by_longest_key(rows, _keys(spark)), "venue").select("doc_id", folder.alias("folder"))


def _keys(spark):
    """The dictionary of venues: names of good journals and the folders they stand for."""
    return spark.createDataFrame([(x,) for x in v.GOOD_VENUES], "key string").select("key", c.safe_name(F.col("key")).alias("value"))


# Venues in the forms that harvests have them in.
_DRESSED = (("", ""), ("", " (Print)"), ("", " (Amsterdam, Netherlands)"), ("", " (Nature Publishing Group)"), ("Signature of ", ""), ("", " &amp; more &#38; caf&eacute;"), ("The ", ", reviews (online)"), ("adv. mater. und ", ""), (" ", " "))
_WORN = "worn AS (SELECT doc_id, {0}[CAST(doc_id % {2} + 1 AS INTEGER)] || venue || {1}[CAST(doc_id % {2} + 1 AS INTEGER)] AS venue FROM papers)".format(*(sql_list([x[i] for x in _DRESSED]) for i in (0, 1)), len(_DRESSED))
_LONG = f"lower({_CLEAN})"
for _short in sorted(v.VENUE_ABBREVIATIONS, key=lambda x: -len(x)):
    _LONG = f"replace({_LONG}, {quoted(_short)}, {quoted(v.VENUE_ABBREVIATIONS[_short])})"
_BARE = r"trim(regexp_replace({}, '\s*\([^)]*\)', '', 'g'))"
_LONG = r"trim(regexp_replace(regexp_replace(" + _LONG + r", '\s*\([^)]*\)', '', 'g'), '\s+', ' ', 'g'))"


@query("venue_classify", f"""WITH {PAPERS}, {_WORN}, vs AS (SELECT DISTINCT venue AS id, {_CLEAN} AS clean, {_LONG} AS long_ FROM worn),
ks AS (SELECT lower(k) AS k, min({_SAFE.format("k")}) AS value FROM (SELECT unnest({sql_list(v.GOOD_VENUES)}) AS k) GROUP BY 1),
one AS (SELECT id, lower(clean) AS v FROM vs), two AS (SELECT id, long_ AS v FROM vs),
inside1 AS ({_INSIDE.format("one")}), inside2 AS ({_INSIDE.format("two")}),
rules AS (SELECT id, coalesce(a.value, b.value, c.value) AS e1, i.value AS l1, d.value AS e2, j.value AS l2, clean FROM vs
  LEFT JOIN ks a ON a.k = lower(trim(id)) LEFT JOIN ks b ON b.k = lower(clean) LEFT JOIN ks c ON c.k = lower({_BARE.format("clean")}) LEFT JOIN inside1 i ON i.id = vs.id AND i.r = 1
  LEFT JOIN ks d ON d.k = long_ LEFT JOIN inside2 j ON j.id = vs.id AND j.r = 1)
SELECT id AS venue, CASE WHEN clean = '' THEN 'Unknown' ELSE coalesce(e1, l1, e2, l2, {_SAFE.format("clean")}) END AS folder,
  CASE WHEN clean = '' THEN 'empty' WHEN e1 IS NOT NULL THEN 'exact' WHEN l1 IS NOT NULL THEN 'longest' WHEN e2 IS NOT NULL THEN 'exact_long' WHEN l2 IS NOT NULL THEN 'longest_long' ELSE 'safe' END AS rule FROM rules""".replace("SELECT id, coalesce(a.value", "SELECT vs.id AS id, coalesce(a.value").replace("lower(trim(id))", "lower(trim(vs.id))"))
def venue_classify(spark, sf_dir):
    i = F.col("doc_id") % len(_DRESSED)
    worn = papers(spark, sf_dir).select(F.concat(pick(tuple(x[0] for x in _DRESSED), i), "venue", pick(tuple(x[1] for x in _DRESSED), i)).alias("venue"))
    return c.classify_venues(worn, _keys(spark))


@query("doi_to_filename", f"WITH {PAPERS} SELECT doc_id, replace(doi, '/', '_') || '.pdf' AS name, sha1(lower(doi)) AS paper_id FROM papers WHERE doi IS NOT NULL")
def doi_to_filename(spark, sf_dir):
    return papers(spark, sf_dir).where("doi is not null").select("doc_id", i.doi_to_filename(F.col("doi")).alias("name"), i.paper_id(F.col("doi")).alias("paper_id"))


@query("filename_to_doi", f"""WITH {PAPERS}, named AS (SELECT doc_id, string_split(replace(doi, '/', '_') || '_a_b', '_') AS p FROM papers WHERE doi IS NOT NULL)
SELECT doc_id, idx, p[1] || '/' || array_to_string(p[2:CAST(idx + 1 AS INTEGER)], '/') || CASE WHEN len(p) > idx + 1 THEN '/' || array_to_string(p[CAST(idx + 2 AS INTEGER):], '_') ELSE '' END AS candidate
FROM (SELECT doc_id, p, unnest(range(1, least(len(p) - 1, 4) + 1)) AS idx FROM named)""")
def filename_to_doi(spark, sf_dir):
    named = papers(spark, sf_dir).where("doi is not null").select("doc_id", i.filename_to_dois(F.concat(F.translate("doi", "/", "_"), F.lit("_a_b.pdf"))).alias("c"))
    return named.select("doc_id", F.posexplode("c").alias("p", "candidate")).select("doc_id", (F.col("p") + 1).cast("long").alias("idx"), "candidate")


_CITED = "cited AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'DOI: ' || doi || 'abcdefgh. ' || text WHEN 1 THEN text || ' see ' || doi || 'abcdefgh;' WHEN 2 THEN 'at ' || doi || 'abcdefgh, ' || text ELSE text END AS body FROM papers)"


@query("doi_extract", rf"""WITH {PAPERS}, {_CITED},
parts AS (SELECT doc_id, regexp_replace(regexp_extract(substring(body, 1, CAST(floor(length(body) / 4.0) AS INTEGER)), '(?i)DOI\s*[：:]\s*(10\.\d{{4,}}/\S+)', 1), '[.,;:]+$', '') AS label,
  list_filter(list_transform(regexp_extract_all(substring(body, 1, CAST(greatest(floor(length(body) / 3.0), 2000) AS INTEGER)), {quoted(i.DOI)}), lambda d: regexp_replace(d, '[.,;:]+$', '')), lambda d: length(d) >= 15) AS early,
  list_filter(list_transform(regexp_extract_all(body, {quoted(i.DOI)}), lambda d: regexp_replace(d, '[.,;:]+$', '')), lambda d: length(d) >= 15) AS anywhere FROM cited WHERE body IS NOT NULL)
SELECT doc_id, coalesce(CASE WHEN length(label) >= 15 THEN label END, early[1], anywhere[1]) AS doi FROM parts""")
def doi_extract(spark, sf_dir):
    end = F.concat(F.col("doi"), F.lit("abcdefgh"))
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("DOI: "), end, F.lit(". "), "text")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" see "), end, F.lit(";"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("at "), end, F.lit(", "), "text")).otherwise(F.col("text"))
    return papers(spark, sf_dir).select("doc_id", body.alias("body")).where("body is not null").select("doc_id", i.doi_in_text(F.col("body")).alias("doi"))


_PUB = "CASE split_part(publisher_doi, '/', 1) " + " ".join(f"WHEN {quoted(k)} THEN {quoted(x)}" for k, x in v.PUBLISHERS.items()) + " ELSE 'unknown' END"


@query("publisher_from_doi", f"WITH {PAPERS} SELECT {_PUB} AS publisher, count(*) AS n FROM papers GROUP BY 1")
def publisher_from_doi(spark, sf_dir):
    return papers(spark, sf_dir).groupBy(i.publisher(F.col("publisher_doi")).alias("publisher")).agg(F.count("*").alias("n"))
