"""Secrets in texts, told apart by how many owners share them.

Everything here is DataFrame functions: patterns mark their matches with control
characters, the marked text is split there, and the pieces' lengths give the places.
A value seen under many owners is an example that people copy; a value seen under few
looks live and belongs to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut

#: Kinds in their order: name, pattern, group that holds the value, least length of it.
#: The patterns of the first three.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # runs of fewer would be dropped
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 20),
)
BASE = 3
#: A value under so many owners is an example, and so is one under two with so many repositories.
SHARED_OWNERS, SHARED_REPOSITORIES = 3, 6
#: Offsets are summed up in runs of so many matches.
RUN = 256

_OPEN, _CLOSE = "\x01", "\x02"
_SPAN = "array<struct<start:int,kind_no:int,end:int,value:string>>"  # until `find` has hashed the values


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with value computed once, however often it is used in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _offsets(lengths: Column) -> Column:
    """Sums of the lengths before each. An array that grows by an element is copied each
    time, so sums are taken within runs first and those of the runs are put together."""
    none = F.array().cast("array<int>")
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
    run = lambda i: F.aggregate(F.slice(lengths, i * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), none.alias("starts")), step)
    runs = F.transform(F.sequence(F.lit(0), ((F.size(lengths) - 1) / RUN).cast("int")), run)
    put = lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["starts"], F.array(F.transform(r["starts"], lambda x: x + acc["at"]))).alias("starts"))
    return F.flatten(F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("starts")), put)["starts"])


def _spans(text: Column, kind_no: int) -> Column:
    """Matches of one kind: start and end in characters (end exclusive), and the value."""
    _, pattern, group, least = KINDS[kind_no]

    def span(pair: Column) -> Column:
        match = F.substring_index(pair["part"], _CLOSE, 1)
        value = F.regexp_extract(match, f"^{pattern}", group) if group else match
        return F.struct(pair["start"].alias("start"), F.lit(kind_no).alias("kind_no"), (pair["start"] + F.length(match)).alias("end"), value.alias("value"))

    def found(parts: Column) -> Column:
        # every piece but the first begins with a match and has its closing mark
        lengths = F.transform(parts, lambda part, i: F.length(part) - F.when(i > 0, 1).otherwise(0))
        pairs = F.arrays_zip(_let(lengths, _offsets).alias("start"), parts.alias("part"))
        return F.filter(F.transform(F.slice(pairs, F.lit(2), F.size(pairs)), span), lambda s: F.length(s["value"]) >= least)

    parts = F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)
    return F.when(text.rlike(pattern), _let(parts, found).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(name) for name, *_ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """doc_id, owner, repository (within its owner) and the sorted spans of every row, each with
    the SHA-256 of its value: no value as it is gets into what is shuffled or kept.
    Texts are read once. Control characters 1 and 2 stand for no secret's character and
    are put out of the way first, one for one, so places stay."""
    clean = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _OPEN + _CLOSE, "\x03\x03")
    spans = F.array_sort(F.concat(*(_spans(F.col("clean"), i) for i in range(len(KINDS)))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), clean.alias("clean"))
    hashed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value_hash")))
    return rows.select("doc_id", "owner", "repository", hashed.alias("found"))


def ownership(found: DataFrame, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """value_hash, n_documents, n_repositories, n_owners, verdict (shared or live) of every
    value. Distinct repositories and owners are counted in steps, each a sum that tasks
    begin on their own rows, so a value in a third of all documents is no burden. A null owner
    or repository is one of its kind; a text without spans, null or empty, adds nothing; repeated
    rows count each as a document; an empty table has no values."""
    each = found.select("owner", "repository", F.explode(F.array_distinct("found.value_hash")).alias("value_hash"))
    by_repository = each.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    counts = by_owner.groupBy("value_hash").agg(F.sum("n").alias("n_documents"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))
    copied = (F.col("n_owners") >= shared_owners) | (F.col("n_owners") > 1) & (F.col("n_repositories") >= shared_repositories)
    return counts.withColumn("verdict", F.when(copied, "shared").otherwise("live"))


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang", shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and
    n_shared (distinct values of the doc_id by the verdict on them). Values themselves are
    not returned.

    A null text is empty: no spans, and the hash of the empty string. A null owner or
    repository is one of its kind. Repeated rows of a doc_id give rows each; n_live and
    n_shared count over all of them; rows of null doc_id have 0 there. Spans that overlap
    (a token that is also a hex run) are all kept. An empty table gives an empty result.
    """
    found = cut(find(docs, owner, repository))
    verdicts = ownership(found, shared_owners, shared_repositories)
    held = found.where("doc_id is not null and size(found) > 0").select("doc_id", F.explode("found.value_hash").alias("value_hash")).distinct()
    counts = held.join(verdicts.select("value_hash", "verdict"), "value_hash").groupBy("doc_id").agg(
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "shared").alias("n_shared")
    )
    of = lambda i: F.size(F.filter("found", lambda s: s["kind_no"] == i)).cast("long")
    rows = found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_joined(F.filter("found", lambda s: s["kind_no"] < BASE)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
    )
    return rows.join(counts, "doc_id", "left").fillna(0, ["n_live", "n_shared"])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql() -> str:
    """The same in DuckDB's SQL, over `documents` with source as owner and lang as repository."""
    found = "\nUNION ALL ".join(
        f"SELECT doc_id, source, lang, {k} AS kind_no, {_quoted(name)} AS kind, {least} AS least_, {_quoted('^' + pattern) if group else 'NULL'} AS again, "
        f"string_split(regexp_replace(t, {_quoted(pattern)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS p FROM clean WHERE regexp_matches(t, {_quoted(pattern)})"
        for k, (name, pattern, group, least) in enumerate(KINDS)
    )
    return f"""WITH clean AS (SELECT doc_id, source, lang, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
parts AS ({found}),
each AS (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM parts),
placed AS (SELECT doc_id, source, lang, kind_no, kind, least_, CAST(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) - (i - 2) AS BIGINT) AS start_, split_part(p[i], chr(2), 1) AS m, again FROM each),
valued AS (SELECT *, CASE WHEN again IS NULL THEN m ELSE regexp_extract(m, again, 2) END AS value FROM placed),
spans AS (SELECT *, kind || ':' || CAST(start_ AS VARCHAR) || ':' || CAST(start_ + length(m) AS VARCHAR) AS span, sha256(value) AS h FROM valued WHERE length(value) >= least_),
owners AS (SELECT h, count(DISTINCT source) >= {SHARED_OWNERS} OR count(DISTINCT source) > 1 AND count(DISTINCT (source, lang)) >= {SHARED_REPOSITORIES} AS copied FROM spans GROUP BY h),
counts AS (SELECT doc_id, count(DISTINCT CASE WHEN NOT copied THEN h END) AS n_live, count(DISTINCT CASE WHEN copied THEN h END) AS n_shared FROM spans JOIN owners USING (h) GROUP BY doc_id),
rows_ AS (SELECT doc_id, sum(CASE WHEN kind_no = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN kind_no = 1 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN kind_no = 2 THEN 1 ELSE 0 END) AS c,
  string_agg(CASE WHEN kind_no < {BASE} THEN span END, ',' ORDER BY start_, kind_no) AS base, string_agg(span, ',' ORDER BY start_, kind_no) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM documents d LEFT JOIN rows_ r ON d.doc_id = r.doc_id LEFT JOIN counts k ON d.doc_id = k.doc_id"""


SQL = _sql()
