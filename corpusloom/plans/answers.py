"""Queries of answer checking, compounds and page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import answers as a
from corpusloom.operators import layout, materials
from corpusloom.plans.standins import pick, quoted, sql_list
from corpusloom.registry import query
from corpusloom.session import table

# Forms in which turns cite, suggest and call, put around their text.
_CITES = ("[📄](/api/pdf/Doc{n})", "[📄](/api/pdf/Doc{n}.pdf)", "[📄](Document_{n}00)", "no source", "[⚠️ 未验证引用](/api/pdf/Doc{n})")
_TAILS = ("\n---\n💡 **继续深入**：\n1. Which phase is stable\n2. abc\n3. What about yields of it\n", "\nIs this a good question at all?\nno?", "")
_CALLS = ('<tool_call>\n{{"name": "search", "arguments": {{"q": "x{n}"}}}}\n</tool_call>', '<tool_call>{{"name": "", "arguments": {{}}}}</tool_call>', '<tool_call>{{"name": "read", "arguments": [1]}}</tool_call>', "<tool_call>{{broken</tool_call>", "plain")


def _sql_pick(values, index):
    return sql_list(list(values)) + f"[CAST({index} AS INTEGER) + 1]"


def _filled(form, n):
    return F.replace(form, F.lit("{n}"), n)


_N = "CAST(conv_id % 7 AS VARCHAR)"
_ANSWERS = f"""answers AS (SELECT conv_id, turn, text || ' ' || replace({_sql_pick(_CITES, "(conv_id + turn) % 5")}, '{{n}}', {_N}) || ' ' || replace({_sql_pick(_CITES, "turn % 5")}, '{{n}}', CAST(turn AS VARCHAR)) || {_sql_pick(_TAILS, "(conv_id + turn) % 3")} AS answer,
  ['Doc1', 'Doc2', 'Document_300', 'Doc' || CAST(turn AS VARCHAR)] AS validated FROM conversations WHERE role = 'assistant')"""


def _answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    turn, conv = F.col("turn"), F.col("conv_id")
    answer = F.concat("text", F.lit(" "), _filled(pick(_CITES, (conv + turn) % 5), (conv % 7).cast("string")), F.lit(" "), _filled(pick(_CITES, turn % 5), turn.cast("string")), pick(_TAILS, (conv + turn) % 3))
    return rows.select("conv_id", "turn", answer.alias("answer"), F.array(F.lit("Doc1"), F.lit("Doc2"), F.lit("Document_300"), F.concat(F.lit("Doc"), turn.cast("string"))).alias("validated"))


_CITED = "list_distinct(list_transform(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(answer, {quoted(p)}, 1)" for p in a.CITED[:2]) + f"), regexp_extract_all(answer, {quoted(a.CITED[2])}, 1)), lambda x: replace(x, '.pdf', '')))"


@query("citation_check", f"WITH {_ANSWERS}, found AS (SELECT conv_id, turn, {_CITED} AS c, validated FROM answers) SELECT conv_id, turn, CAST(len(c) AS BIGINT) AS n_cited, array_to_string(list_sort(list_filter(c, lambda x: NOT list_contains(validated, x))), ',') AS fake FROM found")
def citation_check(spark, sf_dir):
    fake = a.unverified(F.col("answer"), F.col("validated"))
    return _answers(spark, sf_dir).select("conv_id", "turn", F.size(a.cited(F.col("answer"))).cast("long").alias("n_cited"), F.array_join(F.array_sort(fake), ",").alias("fake"))


@query("citation_rewrite")
def citation_rewrite(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", a.marked(F.col("answer"), a.unverified(F.col("answer"), F.col("validated"))).alias("answer"))


@query("suggestion_parse", rf"""WITH {_ANSWERS}, blocks AS (SELECT conv_id, turn, answer, list_filter(list_transform(string_split(regexp_extract(answer, {quoted(a.SUGGESTIONS)}, 1), chr(10)), lambda x: trim(regexp_replace(trim(x), '^\d+\.\s*', ''))), lambda x: length(x) > 5) AS b,
  list_filter(list_transform(string_split(answer, chr(10)), lambda x: trim(x)), lambda x: suffix(x, '?') AND length(x) > 10) AS q FROM answers)
SELECT conv_id, turn, array_to_string((CASE WHEN len(b) > 0 THEN b ELSE q END)[1:3], '|') AS suggestions FROM blocks""")
def suggestion_parse(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(a.suggestions(F.col("answer")), "|").alias("suggestions"))


@query("tool_call_parse", f"""WITH said AS (SELECT conv_id, turn, text || ' ' || replace(replace(replace({_sql_pick(_CALLS, "(conv_id + turn) % 5")}, '{{n}}', {_N}), '{{{{', '{{'), '}}}}', '}}') AS t FROM conversations),
body AS (SELECT conv_id, turn, nullif(regexp_extract(t, '(?s)<tool_call>\\s*(.*?)\\s*</tool_call>', 1), '') AS b FROM said),
parsed AS (SELECT conv_id, turn, CASE WHEN json_valid(b) THEN b END AS b FROM body)
SELECT conv_id, turn, nullif(json_extract_string(b, '$.name'), '') AS name, CASE WHEN nullif(json_extract_string(b, '$.name'), '') IS NULL THEN NULL WHEN json_type(b, '$.arguments') = 'OBJECT' THEN json_extract_string(b, '$.arguments.q') END AS q FROM parsed""")
def tool_call_parse(spark, sf_dir):
    conv, turn = F.col("conv_id"), F.col("turn")
    form = F.replace(F.replace(_filled(pick(_CALLS, (conv + turn) % 5), (conv % 7).cast("string")), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    call = a.tool_call(F.concat("text", F.lit(" "), form))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", call["name"].alias("name"), F.get_json_object(call["arguments"], "$.q").alias("q"))


# Compounds of parts: species and amounts chosen by the key.
_A, _B, _X = ("Cs", "MA", "FA", "Rb", "Cs0.1FA0.9"), ("Pb", "Sn", "Ge", "Sr"), ("I3", "Br3", "Cl3", "(Br0.5I0.5)3")
_MEAN_A = [1.88, 2.17, 2.53, 1.72, 0.1 * 1.88 + 0.9 * 2.53]
_MEAN_B = [1.19, 1.18, 0.73, 1.18]
_MEAN_X = [2.20, 1.96, 1.81, (1.96 + 2.20) / 2]


@query("tolerance_factor", f"""WITH f AS (SELECT p_partkey, CAST(p_partkey % 5 AS INTEGER) + 1 AS i, CAST(p_partkey % 4 AS INTEGER) + 1 AS j, CAST((p_partkey // 4) % 4 AS INTEGER) + 1 AS k FROM part),
r AS (SELECT p_partkey, {sql_list(list(_A))}[i] || {sql_list(list(_B))}[j] || {sql_list(list(_X))}[k] AS formula, {_MEAN_A}[i] AS a, {_MEAN_B}[j] AS b, {_MEAN_X}[k] AS x FROM f),
v AS (SELECT *, CAST((a + x) / (sqrt(2.0) * (b + x)) AS DOUBLE) AS t, CAST(b / x AS DOUBLE) AS mu FROM r)
SELECT p_partkey, formula, round(t, 4) AS t, round(mu, 4) AS mu, CASE WHEN t > 1.0 THEN 'hexagonal' WHEN t >= 0.9 THEN 'cubic' WHEN t >= 0.8 THEN 'tetragonal/orthorhombic' WHEN t >= 0.7 THEN 'orthorhombic or none' ELSE 'none' END AS crystal,
  t >= 0.71 AND t <= 1.0 AND mu >= 0.41 AND mu <= 0.90 AS stable FROM v""")
def tolerance_factor(spark, sf_dir):
    k = F.col("p_partkey")
    formula = F.concat(pick(_A, k % 5), pick(_B, k % 4), pick(_X, F.floor(k / 4) % 4))
    rows = materials.tolerance(table(spark, sf_dir, "part").select("p_partkey", formula.alias("formula")))
    return rows.select("p_partkey", "formula", F.round("t", 4).alias("t"), F.round("mu", 4).alias("mu"), "crystal", "stable")


@query("formula_species", """WITH f AS (SELECT p_partkey, CAST(p_partkey % 9 + 1 AS DOUBLE) / 10 AS a, CAST(p_partkey % 4 + 1 AS DOUBLE) AS b, CAST(p_partkey % 3 + 2 AS DOUBLE) AS c FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN [2.17, 2.53] WHEN p_partkey % 3 = 1 THEN [1.5] ELSE [(1.88 * a + b * (2.17 + c * 2.53)) / (a + b * (1 + c))] END[1] AS r_a,
  CASE WHEN p_partkey % 3 = 0 THEN round(a + b * (1 + c), 6) WHEN p_partkey % 3 = 1 THEN 1.0 ELSE round(a, 6) END AS amount_a, p_partkey % 3 = 2 AS scanned,
  CASE WHEN p_partkey % 3 = 0 THEN round(b * c, 6) END AS inner_amount FROM f""".replace("[2.17, 2.53]", "[2.17]"))
def formula_species(spark, sf_dir):
    """Formulas with brackets in brackets, with a cation that no table has, and texts that are
    none and are scanned for symbols."""
    k = F.col("p_partkey")
    a, b, c = ((k % 9 + 1) / 10).cast("decimal(3,1)").cast("string"), (k % 4 + 1).cast("string"), (k % 3 + 2).cast("string")
    nested = F.concat(F.lit("Cs"), a, F.lit("(MA[FA]"), c, F.lit(")"), b, F.lit("PbI3"))
    formula = F.when(k % 3 == 0, nested).when(k % 3 == 1, "ACPb(Br0.5I0.5)3").otherwise(F.concat(F.lit("MA"), a, F.lit("-Pb with Br?")))
    rows = table(spark, sf_dir, "part").select("p_partkey", formula.alias("formula"))
    made = materials.tolerance(rows).withColumn("s", materials.sites(F.col("formula")))
    amounts = F.aggregate("s.a", F.lit(0.0), lambda t, p: t + p["amount"])
    inner = F.get(F.filter("s.a", lambda p: p["symbol"] == "FA"), F.lit(0))["amount"]
    return made.select("p_partkey", "r_a", F.round(amounts, 6).alias("amount_a"), "s.scanned", F.round(inner, 6).alias("inner_amount"))


def _blocks(spark, sf_dir):
    """Events as blocks of pages: a user is a document, ten events are a page."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc"), F.floor(e / 500).cast("long").alias("page"), e.alias("block"), (F.col("value") % 300).alias("x0"), ((e % 500) * 1.5).alias("y0"),
        (F.col("value") % 300 + 200).alias("x1"), ((e % 500) * 1.5 + 10).alias("y1"), F.concat("event_type", F.lit(" "), e.cast("string")).alias("text"),
    )


_BLOCKS = "blocks AS (SELECT user_id AS doc, event_id // 500 AS page, event_id AS block, value % 300 AS x0, (event_id % 500) * 1.5 AS y0, value % 300 + 200 AS x1, (event_id % 500) * 1.5 + 10 AS y1, event_type || ' ' || CAST(event_id AS VARCHAR) AS text FROM events)"


@query("layout_paragraphs", f"""WITH {_BLOCKS}, m AS (SELECT *, CASE WHEN lag(y1) OVER w IS NULL OR abs(y0 - lag(y1) OVER w) >= greatest((y1 - y0) * 2, 15) OR abs((x0 + x1) / 2 - lag((x0 + x1) / 2) OVER w) >= 240 THEN 1 ELSE 0 END AS s FROM blocks WINDOW w AS (PARTITION BY doc, page ORDER BY y0, block)),
n AS (SELECT *, sum(s) OVER (PARTITION BY doc, page ORDER BY y0, block ROWS UNBOUNDED PRECEDING) AS paragraph FROM m)
SELECT doc, page, CAST(paragraph AS BIGINT) AS paragraph, round(CAST(min(x0) AS DOUBLE), 6) AS x0, round(CAST(min(y0) AS DOUBLE), 6) AS y0, round(CAST(max(x1) AS DOUBLE), 6) AS x1, round(CAST(max(y1) AS DOUBLE), 6) AS y1, string_agg(text, ' ' ORDER BY y0, block) AS text, count(*) AS n_blocks FROM n GROUP BY doc, page, paragraph""")
def layout_paragraphs(spark, sf_dir):
    found = layout.boxes(layout.paragraphs(_blocks(spark, sf_dir), 600.0))
    return found.select("doc", "page", "paragraph", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")), "text", "n_blocks")


@query("layout_columns", f"""WITH {_BLOCKS}, s AS (SELECT doc, page, count(*) AS n, max(CASE WHEN (x0 + x1) / 2 < 300 THEN (x0 + x1) / 2 END) AS l, min(CASE WHEN (x0 + x1) / 2 >= 300 THEN (x0 + x1) / 2 END) AS r FROM blocks GROUP BY doc, page)
SELECT doc, page, CASE WHEN n >= 5 AND r - l > 48 THEN round((l + r) / 2, 6) END AS boundary FROM s""")
def layout_columns(spark, sf_dir):
    return layout.columns(_blocks(spark, sf_dir), 600.0).withColumn("boundary", F.round("boundary", 6))


@query("lines_in_paragraphs", f"""WITH {_BLOCKS}, p AS (SELECT doc, page, min(y0) AS a, max(y1) AS b FROM blocks WHERE block % 3 = 0 GROUP BY doc, page)
SELECT blocks.doc, blocks.page, count(*) AS n FROM blocks JOIN p ON blocks.doc = p.doc AND blocks.page = p.page WHERE y0 >= a - 2 AND y1 <= b + 2 GROUP BY blocks.doc, blocks.page""")
def lines_in_paragraphs(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    found = layout.boxes(blocks.where("block % 3 = 0").withColumn("paragraph", F.lit(0)))
    return layout.lines_within(blocks, found).groupBy("doc", "page").agg(F.count("*").alias("n"))
