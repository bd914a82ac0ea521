"""Text cleaning, normalisation and similarity as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import vocabulary as v


def _nfkc(text: Column) -> Column:
    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return composed(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_title(text: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def normalize_passage(text: Column) -> Column:
    """Without bold, italic and heading marks, in NFKC, punctuation as blanks, lower case."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^#{1,6}\s*", ""), r"\*{1,3}|_{2,3}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_nfkc(bare)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def ngrams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; none of a shorter text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of runs of n characters; empty texts 0; shorter ones by equality."""
    x, y = ngrams(a, n), ngrams(b, n)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when((F.length(a) < n) | (F.length(b) < n), (a == b).cast("double")).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def printable(text: Column) -> Column:
    """Control and other invisible characters, but line breaks and tabs, as blanks."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\r\t]]", " ")


def _until_cut(text: Column, cut: str) -> Column:
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: strip(x).rlike(cut)), True)
    return F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)


def _joined(lines: Column) -> Column:
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def clean_plain(text: Column) -> Column:
    """Up to the first closing heading, without captions, page numbers, notices or blank lines."""
    return _joined(F.filter(_until_cut(text, v.CUT_A), lambda x: ~strip(x).rlike(v.SKIP_A) & (strip(x) != "")))


def clean_extracted(text: Column) -> Column:
    """Up to the first closing heading, without noise lines; blank lines stay."""
    kept = F.filter(_until_cut(text, v.CUT_B), lambda x: (strip(x) == "") | ~strip(x).rlike(v.SKIP_B))
    return _joined(F.transform(kept, lambda x: F.when(strip(x) == "", "").otherwise(x)))


def clean_markdown(text: Column) -> Column:
    """Without picture blocks, bare breaks, correction notices, empty headings and captions,
    up to a heading of references or acknowledgements."""
    t = F.regexp_replace(text, r"(?s)<!-- Start of picture text -->.*?<!-- End of picture text -->", "")
    t = F.regexp_replace(t, r"(?m)^\s*(\w+\s*)?(<br>\s*)+$", "")
    t = F.regexp_replace(t, v.CORRECTION, "")
    t = F.regexp_replace(t, r"(?m)^#{1,4}\s*$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    lines = F.split(t, "\n")
    at = F.array_position(F.transform(lines, lambda x: strip(x).rlike(v.CUT_HEADING) & (F.length(strip(x)) < 80) & strip(x).rlike(r"(?i)references|acknowledg")), True)
    t = F.array_join(F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines), "\n")
    return strip(F.regexp_replace(t, v.CAPTION, ""))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in the (lower-case) text."""
    return F.size(F.filter(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(text, w)))


def keyword_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z]{3,}|[\x{4e00}-\x{9fff}]+"), F.lit(0)))


def keyword_overlap(a: Column, b: Column) -> Column:
    """Shared words over those of the shorter side; 0 if either has none."""
    x, y = keyword_tokens(a), keyword_tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(0.0)


def data_content_score(text: Column) -> Column:
    return F.least(hits(F.lower(text), v.DATA_CONTENT) / 10, F.lit(1.0))
