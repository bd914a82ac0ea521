"""Rule-based classifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import vocabulary as v
from corpusloom.functions.text import hits


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    """As `hits`, but short Latin keywords count as whole words alone."""
    short = [w for w in words if w.isascii() and len(w) <= 4]
    return hits(text, tuple(w for w in words if w not in short)) + sum((text.rlike(rf"\b{w}\b").cast("int") for w in short), F.lit(0))


def paper_type(source: Column, title: Column, preview: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, preview, source))
    return F.when(hits(text, v.REVIEW) > 0, "review").otherwise("experimental")


def question_type(text: Column) -> Column:
    """specific if its keywords, strong ones twice, outnumber the broad ones; else broad."""
    t = F.lower(text)
    return F.when(_hits(t, v.SPECIFIC) + _hits(t, v.STRONG_SPECIFIC) > _hits(t, v.BROAD), "specific").otherwise("broad")


def intent(text: Column, is_followup: Column | None = None, has_pool: Column | None = None) -> Column:
    """chat or research, by the first rule that applies."""
    t, short = F.lower(text), F.length(text) < 50
    chat, research = hits(t, v.CHAT), hits(t, v.RESEARCH)
    follows = (is_followup if is_followup is not None else F.lit(False)) & (has_pool if has_pool is not None else F.lit(False))
    return (
        F.when(short & (research == 0), "chat")
        .when(follows & (chat == 0), "research")
        .when(research > chat, "research")
        .when(chat > research, "chat")
        .when(short & (F.contains(t, F.lit("what is")) | F.contains(t, F.lit("什么是"))), "chat")
        .when(research > 0, "research")
        .otherwise(F.when(short, "chat").otherwise("research"))
    )


def response_style(text: Column) -> Column:
    """Struct of style, format and dissatisfied. The first style with the most keywords wins."""
    t = F.lower(text)
    data, how, compare = (hits(t, w) for w in (v.DATA_LOOKUP, v.HOW_TO, v.COMPARE))
    most = F.greatest(data, how, compare)
    style = F.when(most == 0, "overview").when(data == most, "data_lookup").when(how == most, "how_to").otherwise("compare")
    form = F.coalesce(*(F.when(F.contains(t, F.lit(word)), kind) for word, kind in v.FORMATS))
    missing = F.contains(t, F.lit("没有")) & t.rlike("吗|？|\\?")
    return F.struct(style.alias("style"), form.alias("format"), ((hits(t, v.FRUSTRATION) > 0) | missing).alias("dissatisfied"))
