"""Payloads of services as rows of one form: Atom feeds, journal indexes, paper details,
device and material databases. A payload is a text column; how it was fetched is not
looked at here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FEED = (
    "entry array<struct<id: string, title: string, summary: string, published: string, author: array<struct<name: string>>, link: array<struct<_title: string, _href: string>>,"
    " primary_category: struct<_term: string>, journal_ref: string, comment: string>>"
)
_DATE = "struct<`date-parts`: array<array<int>>>"
_INDEX = (
    "message struct<items: array<struct<DOI: string, title: array<string>, `is-referenced-by-count`: int, `published-print`: " + _DATE + ", `published-online`: " + _DATE + ","
    " author: array<struct<given: string, family: string>>, abstract: string, URL: string>>, `container-title`: array<string>, publisher: string>"
)
_DETAILS = (
    "paperId string, title string, abstract string, tldr struct<text: string>, authors array<struct<name: string>>, year int, venue string, citationCount int,"
    " externalIds struct<DOI: string, ArXiv: string>, fieldsOfStudy array<string>, openAccessPdf struct<url: string>"
)
#: Names that device databases have for a field, the first one that is there counts. Fixed values.
DEVICE_FIELDS = {
    "pce": ("pce", "efficiency", "PCE"), "voc": ("voc", "Voc", "VOC"), "jsc": ("jsc", "Jsc", "JSC"), "ff": ("ff", "FF", "fill_factor"), "composition": ("perovskite_composition", "composition"),
    "stack": ("device_stack", "architecture"), "method": ("deposition_method", "method"), "stability": ("stability", "stability_test"),
}


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def atom_entries(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """The other columns of rows and, for each entry of an Atom feed, title, summary, published,
    authors, pdf_url, arxiv_id, category, journal_ref, comment. Line breaks in titles and
    summaries become blanks; what is missing is empty. Feeds that are none have no entries."""
    kept = [c for c in rows.columns if c != payload]
    feed = F.from_xml(F.col(payload), _FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    entries = rows.select(*kept, F.explode(feed["entry"]).alias("e"))
    line = lambda c: F.regexp_replace(F.trim(_text(F.col(c))), "\n", " ")
    pdf = F.get(F.filter("e.link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    names = F.filter(F.transform(F.coalesce("e.author", F.array().cast("array<struct<name:string>>")), lambda a: F.trim(a["name"])), lambda n: F.length(n) > 0)
    return entries.select(
        *kept, line("e.title").alias("title"), line("e.summary").alias("summary"), F.substring(F.trim(_text(F.col("e.published"))), 1, 10).alias("published"), names.alias("authors"), _text(pdf).alias("pdf_url"),
        F.element_at(F.split(F.trim(_text(F.col("e.id"))), "/abs/"), -1).alias("arxiv_id"), _text(F.col("e.primary_category._term")).alias("category"), F.trim(_text(F.col("e.journal_ref"))).alias("journal_ref"), F.trim(_text(F.col("e.comment"))).alias("comment"),
    )


def _year(printed: Column, online: Column) -> Column:
    """Year in print, else online, else 0; a 0 counts as none."""
    first = lambda d: F.nullif(F.get(F.get(d["date-parts"], F.lit(0)), F.lit(0)), F.lit(0))
    return F.coalesce(first(printed), first(online), F.lit(0))


def index_items(rows: DataFrame, payload: str = "payload", fresh: int = 2025, least: int = 50) -> DataFrame:
    """Articles of a journal index's answers that have an identifier and are cited enough (new
    ones in any case): doi, title, year, cited, authors, abstract (500 characters), url."""
    kept = [c for c in rows.columns if c != payload]
    items = rows.select(*kept, F.explode(F.from_json(payload, _INDEX)["message"]["items"]).alias("i"))
    named = F.filter(F.coalesce("i.author", F.array().cast("array<struct<given:string,family:string>>")), lambda a: F.length(a["family"]) > 0)
    authors = F.transform(named, lambda a: F.trim(F.concat(_text(a["given"]), F.lit(" "), a["family"])))
    out = items.select(
        *kept, F.col("i.DOI").alias("doi"), _text(F.get("i.title", F.lit(0))).alias("title"), _year(F.col("i.published-print"), F.col("i.published-online")).alias("year"), F.coalesce("i.is-referenced-by-count", F.lit(0)).alias("cited"),
        authors.alias("authors"), F.substring(_text(F.col("i.abstract")), 1, 500).alias("abstract"), _text(F.col("i.URL")).alias("url"),
    )
    return out.where((F.length("doi") > 0) & (F.col("cited") >= F.when(F.col("year") >= fresh, 0).otherwise(least)))


def venue_of(payload: Column) -> Column:
    """The journal that an index names for an identifier, else its publisher, else null."""
    message = F.from_json(payload, _INDEX)["message"]
    return F.coalesce(F.nullif(F.get(message["container-title"], F.lit(0)), F.lit("")), F.nullif(message["publisher"], F.lit("")))


def paper_details(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """The details of papers, with their summary of one line; answers without a paper are left out."""
    kept = [c for c in rows.columns if c != payload]
    p = rows.select(*kept, F.from_json(payload, _DETAILS).alias("p")).where(F.length("p.paperId") > 0)
    names = F.filter(F.transform(F.coalesce("p.authors", F.array().cast("array<struct<name:string>>")), lambda a: a["name"]), lambda n: F.length(n) > 0)
    return p.select(
        *kept, "p.paperId", F.regexp_replace(_text(F.col("p.title")), "\n", " ").alias("title"), F.substring(_text(F.col("p.abstract")), 1, 1200).alias("abstract"), _text(F.col("p.tldr.text")).alias("tldr"), names.alias("authors"), "p.year",
        _text(F.col("p.venue")).alias("venue"), F.coalesce("p.citationCount", F.lit(0)).alias("citationCount"), _text(F.col("p.externalIds.DOI")).alias("doi"), _text(F.col("p.externalIds.ArXiv")).alias("arxivId"),
        F.coalesce("p.fieldsOfStudy", F.array().cast("array<string>")).alias("fieldsOfStudy"), _text(F.col("p.openAccessPdf.url")).alias("openAccessUrl"),
    )


def devices(rows: DataFrame, payload: str = "payload", holding: str = "") -> DataFrame:
    """One form for entries of device databases, whatever they call their fields; N/A where
    none is there. `holding` keeps entries whose measured values hold it, in any case."""
    kept = [c for c in rows.columns if c != payload]
    held = rows.select(*kept, F.from_json(payload, "map<string,string>").alias("m"))
    out = held.select(*kept, *(F.coalesce(*(F.col("m")[n] for n in ns), F.lit("N/A")).alias(field) for field, ns in DEVICE_FIELDS.items()))
    measured = F.concat(F.lit("PCE="), "pce", F.lit(" Voc="), "voc", F.lit(" Jsc="), "jsc", F.lit(" FF="), "ff", F.lit(" stability="), "stability")
    return out.where(F.contains(F.lower(measured), F.lit(holding.lower()))) if holding else out


_MATERIALS = "array<struct<entry_id:string,reduced_formula:string,spacegroup:string,data:struct<band_gap:double,formation_energy_per_atom:double>>>"


def material_entries(rows: DataFrame, payload: str = "payload", most: int = 10) -> DataFrame:
    """The first entries that a materials database has for a formula, in its order: place (from
    1), material_id, formula, band_gap_eV, formation_energy_eV_per_atom (0 where it has none)
    and crystal_system (N/A). Answers without entries, or that are none, give no rows."""
    kept = [c for c in rows.columns if c != payload]
    told = rows.select(*kept, F.posexplode(F.slice(F.filter(F.from_json(payload, _MATERIALS), lambda e: e["entry_id"].isNotNull()), 1, most)).alias("at", "e"))
    return told.select(
        *kept, (F.col("at") + 1).alias("place"), F.col("e.entry_id").alias("material_id"), F.col("e.reduced_formula").alias("formula"), F.round(F.coalesce("e.data.band_gap", F.lit(0.0)), 3).alias("band_gap_eV"),
        F.round(F.coalesce("e.data.formation_energy_per_atom", F.lit(0.0)), 4).alias("formation_energy_eV_per_atom"), F.coalesce("e.spacegroup", F.lit("N/A")).alias("crystal_system"),
    )


_POINT = "struct<payload:struct<page_content:string,metadata:struct<source:string,path:string>>>"


def point_catalogue(points: DataFrame, journals: dict[str, str], point: str = "point", order: str = "point_id") -> DataFrame:
    """source, path, journal, title_preview, chunk_count and year of every source that points of
    a vector store (JSON) come from; points without a source are left out.

    The journal is that of the first prefix of the source, else Other; path and year (the folder
    of four digits) are those of the source's first point, the preview is 150 characters of
    its first chunk of more than 20, as specified."""
    p = points.select(F.col(order).alias("at"), F.from_json(point, _POINT)["payload"].alias("p"))
    rows = p.select("at", F.col("p.metadata.source").alias("source"), _text(F.col("p.metadata.path")).alias("path"), _text(F.col("p.page_content")).alias("content")).where(F.length("source") > 0)
    of = rows.groupBy("source").agg(F.min_by("path", "at").alias("path"), F.min_by("content", F.when(F.length("content") > 20, F.col("at"))).alias("content"), F.count("*").alias("chunk_count"))
    journal = F.coalesce(*(F.when(F.startswith("source", F.lit(prefix)), F.lit(name)) for prefix, name in journals.items()), F.lit("Other"))
    year = F.nullif(F.regexp_extract("path", r"/(\d{4})/", 1), F.lit("")).cast("int")
    preview = F.trim(F.translate(F.substring(F.coalesce("content", F.lit("")), 1, 150), "\n", " "))
    return of.select("source", "path", journal.alias("journal"), preview.alias("title_preview"), "chunk_count", year.alias("year"))
