"""Parsing and checking of generated answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.vocabulary import MARKUP

# Marks of citations and of suggestion blocks.
CITED = (r"\[📄\]\(/api/pdf/([^)]+)\)", r"\[📄\]\(([A-Za-z][A-Za-z0-9_\-]{8,})\)", r"\[⚠️ 未验证引用\]\(/api/pdf/([^)]+)\)")
SUGGESTIONS = r"---\s*\n💡\s*\*?\*?继续深入\*?\*?[：:]\s*\n((\d+\.\s*[^\n]+\n?)+)"
TOOL_CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"


def cited(text: Column) -> Column:
    """Identifiers of the documents an answer cites, in any of the forms, each once."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CITED))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(".pdf"), F.lit(""))))


def unverified(text: Column, validated: Column) -> Column:
    return F.array_except(cited(text), validated)


def marked(text: Column, fake: Column) -> Column:
    """The answer with citations of unverified documents marked as such."""

    def mark(done: Column, one: Column) -> Column:
        warning = F.concat(F.lit("[⚠️ 未验证引用](/api/pdf/"), one, F.lit(")"))
        for form in ("[📄](/api/pdf/{})", "[📄](/api/pdf/{}.pdf)", "[📄]({})", "[📄]({}.pdf)"):
            before, after = form.split("{}")
            done = F.replace(done, F.concat(F.lit(before), one, F.lit(after)), warning)
        return done

    return F.aggregate(fake, text, mark)


def suggestions(text: Column, most: int = 3) -> Column:
    """Numbered lines of the block of suggestions (over 5 characters), else lines that end
    in a question mark (over 10)."""
    block = F.split(F.regexp_extract(text, SUGGESTIONS, 1), "\n")
    numbered = F.filter(F.transform(block, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\d+\.\s*", ""))), lambda x: F.length(x) > 5)
    asked = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.endswith(x, F.lit("?")) & (F.length(x) > 10))
    return F.slice(F.when(F.size(numbered) > 0, numbered).otherwise(asked), 1, most)


def without_suggestions(text: Column) -> Column:
    return F.rtrim(F.regexp_replace(text, SUGGESTIONS, ""))


def tool_call(text: Column) -> Column:
    """name and arguments (a JSON object as text) of the first call; null if it is broken or
    has no name; arguments that are no object count as none."""
    body = F.nullif(F.regexp_extract(text, TOOL_CALL, 1), F.lit(""))
    name = F.get_json_object(body, "$.name")
    arguments = F.get_json_object(body, "$.arguments")
    whole = F.try_parse_json(body).isNotNull() & (F.length(name) > 0)
    return F.when(whole, F.struct(name.alias("name"), F.when(arguments.rlike(r"^\s*\{"), arguments).otherwise(F.lit("{}")).alias("arguments")))


def without_markup(text: Column) -> Column:
    """Without tool calls and left-over tags of them."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", ""), r"</?(tool_call|function|parameter|invoke|think)[^>]*>", ""))


def thinking_chain(parts: Column) -> Column:
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.rlike("^(💭|🔧|⚠️)"))
    return F.array_join(kept, "\n\n")


def json_in(text: Column) -> Column:
    """The JSON object in a model's answer: within a fence if it has one, from the first brace
    to the last; null without any."""
    bare = F.trim(text)
    fenced = F.regexp_extract(bare, r"(?s)^```[^\n]*\n(.*)```", 1)
    return F.nullif(F.regexp_extract(F.when(F.startswith(bare, F.lit("```")) & (fenced != ""), fenced).otherwise(bare), r"(?s)\{.*\}", 0), F.lit(""))


def has_markup(text: Column) -> Column:
    """Whether an answer holds signs of tool calls."""
    return F.exists(F.array(*map(F.lit, MARKUP)), lambda w: F.contains(text, w))
