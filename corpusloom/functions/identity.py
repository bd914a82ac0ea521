"""Identifiers, file names and publishers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.vocabulary import PUBLISHERS

DOI = r"10\.\d{4,}/[^\s\"'<>\]]+"


def normalize_doi(doi: Column, keep_hyphen: bool = True) -> Column:
    return F.translate(F.lower(F.trim(doi)), " " if keep_hyphen else " -", "")


def doi_to_filename(doi: Column) -> Column:
    return F.concat(F.translate(doi, '/\\:*?"<>|', "_________"), F.lit(".pdf"))


def filename_to_dois(name: Column) -> Column:
    """Candidates: more and more underscores read as slashes, at most four."""
    parts = F.split(F.regexp_replace(name, r"\.pdf$", ""), "_")
    n = F.size(parts)
    made = F.transform(
        F.sequence(F.lit(1), F.least(n - 1, F.lit(4))),
        lambda k: F.concat_ws("/", parts[0], F.array_join(F.slice(parts, F.lit(2), k), "/"), F.nullif(F.array_join(F.slice(parts, k + 2, F.greatest(n - k - 1, F.lit(0))), "_"), F.lit(""))),
    )
    return F.when(n >= 2, made).otherwise(F.array(parts[0]))


def publisher(doi: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in PUBLISHERS.items() for x in pair))
    return F.coalesce(F.element_at(known, F.split_part(doi, F.lit("/"), F.lit(1))), F.lit("unknown"))


def _tidy(doi: Column) -> Column:
    return F.regexp_replace(doi, r"[.,;:]+$", "")


def doi_in_text(text: Column, least: int = 15, last_page: bool = False) -> Column:
    """A labelled one in the first quarter, else a bare one in the first third (2000
    characters at least), else any; ones that are too short don't count. With last_page a
    labelled one in the last fifth (3000 characters at most) comes before all."""
    quarter = F.substring(text, F.lit(1), F.floor(F.length(text) / 4).cast("int"))
    third = F.substring(text, F.lit(1), F.greatest(F.floor(F.length(text) / 3).cast("int"), F.lit(2000)))
    label = _tidy(F.regexp_extract(quarter, r"(?i)DOI\s*[：:]\s*(10\.\d{4,}/\S+)", 1))
    long = lambda part: F.get(F.filter(F.transform(F.regexp_extract_all(part, F.lit(DOI), F.lit(0)), _tidy), lambda d: F.length(d) >= least), F.lit(0))
    found = F.coalesce(F.when(F.length(label) >= least, label), long(third), long(text))
    if not last_page:
        return found
    size = F.length(text)
    fifth = F.substring(text, F.greatest(F.floor(size * 4 / 5), size - 3000).cast("int") + 1, size)
    last = _tidy(F.regexp_extract(fifth, r"(?i)DOI\s*[：:]\s*(10\.\d{4,}/\S+)", 1))
    return F.coalesce(F.when(F.length(last) >= least, last), found)


def paper_id(doi: Column) -> Column:
    return F.substring(F.sha1(F.lower(doi)), 1, 40)


def year_in_name(name: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"(20\d{2})", 1), F.lit("")), F.lit("9999")).cast("int")


# Where publishers put the document of an identifier ({doi}, or its part after the slash).
DOCUMENT_URLS = {
    "nature": "https://www.nature.com/articles/{rest}.pdf", "science": "https://www.science.org/doi/pdf/{doi}", "acs": "https://pubs.acs.org/doi/pdf/{doi}",
    "rsc": "https://pubs.rsc.org/en/content/articlepdf/{rest}", "elsevier": "https://www.sciencedirect.com/science/article/pii/{rest}/pdfft",
    "springer": "https://link.springer.com/content/pdf/{doi}.pdf", "mdpi": "https://www.mdpi.com/{rest}/pdf",
}


def guess_url(doi: Column) -> Column:
    """Where the publisher puts the document; null for those that have no rule."""
    by, rest = publisher(doi), F.regexp_extract(doi, "^[^/]*/(.*)$", 1)
    return F.coalesce(*(F.when(by == name, F.replace(F.replace(F.lit(form), F.lit("{doi}"), doi), F.lit("{rest}"), rest)) for name, form in DOCUMENT_URLS.items()))


def fallback_name(title: Column) -> Column:
    """A name for a record without identifier: the first half of the MD5 of its title."""
    return F.substring(F.md5(F.coalesce(title, F.lit(""))), 1, 16)


def journal_from_name(name: Column) -> Column:
    """The parts of a file name before its identifier, as words; Unknown without any."""
    before = F.regexp_replace(F.replace(name, F.lit(".pdf"), F.lit("")), r"(^|_)10\.\d.*$", "")
    return F.coalesce(F.nullif(F.translate(before, "_", " "), F.lit("")), F.lit("Unknown"))


def doi_in_source(source: Column) -> Column:
    """The part of a chunk's source from its identifier on; the source as it is if it holds
    none; null for records that have no file (s2:...)."""
    at = F.locate("_10.", source)
    return F.when(~F.startswith(source, F.lit("s2:")), F.when(at > 0, F.substring(source, at + 1, F.length(source))).otherwise(source))


def file_ids(text: Column) -> Column:
    """Identifiers of files that a message names between backquotes, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:File ID:\s*)?`([A-Za-z][A-Za-z0-9_\-]{8,})`"), F.lit(1)))


def listed_papers(text: Column) -> Column:
    """Papers that search results list by source or file, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?:Source:\s*|File ID:\s*`?)([\w\-./]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.rtrim(x, F.lit("."))))


#: Keys of a document's metadata that name an identifier, then those that may mention one. Fixed values.
META_KEYS = ("/dc:identifier", "/prism:doi", "/doi", "/DOI", "/WPS-ARTICLEDOI", "/crossmark:doi", "/Subject", "/Description")


def repaired(text: Column) -> Column:
    """Text with identifiers put together again: blanks around their slash, line ends behind a
    slash, full stop, hyphen or underscore within them, and letters set apart by blanks."""
    near = F.regexp_replace(text, r"(10\.\d{4,})\s*/\s*", "$1/")
    joined = F.regexp_replace(near, r"(10\.\d{4,}/\S*[/._-])[ \t]*\r?\n[ \t]*(?=\S)", "$1")
    apart = F.regexp_extract_all(text, F.lit(r"(?<!\S)1 0 \. (?:\d ){4,}/(?: \S(?!\S))+"), F.lit(0))
    return F.concat_ws("\n", joined, F.array_join(F.transform(apart, lambda run: F.translate(run, " ", "")), "\n"))


def doi_by_evidence(meta: Column, pages: Column, least: int = 15) -> Column:
    """struct<doi, origin> by a cascade: metadata by order of keys (each as it is, then in lower
    case), then the first two pages, then the last one; null without any. Identifiers of fewer
    than `least` characters don't count, and the search goes on."""

    def in_meta(key: str) -> Column:
        held = F.coalesce(F.nullif(F.try_element_at(meta, F.lit(key)), F.lit("")), F.try_element_at(meta, F.lit(key.lower())))
        doi = _tidy(F.regexp_extract(held, DOI, 0))
        return F.when(F.length(doi) >= least, F.struct(doi.alias("doi"), F.lit(key).alias("origin")))

    def in_text(text: Column, origin: str) -> Column:
        doi = doi_in_text(repaired(text), least)
        return F.when(doi.isNotNull(), F.struct(doi.alias("doi"), F.lit(origin).alias("origin")))

    first = F.concat_ws("\n", F.slice(pages, 1, 2))
    return F.coalesce(*map(in_meta, META_KEYS), in_text(first, "first pages"), F.when(F.size(pages) > 2, in_text(F.element_at(pages, -1), "last page")))
