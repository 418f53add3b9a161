"""Coarse word classes by an ordered cascade: closed classes, a gazetteer, endings, case, nouns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = ("NOUN", "PROPN", "VERB", "AUX", "ADJ", "ADV", "PRON", "DET", "ADP", "CONJ", "PART", "NUM", "INTJ", "PUNCT", "X")
#: Closed classes in the order in which they are tried; a parameter, here a small English set.
CLOSED = {
    "DET": {"the", "a", "an"}, "PRON": {"i", "you", "he", "she", "it", "we", "they", "this", "that"}, "AUX": {"is", "are", "was", "be"}, "ADP": {"of", "in", "on", "at", "by", "with", "to", "for"},
    "CONJ": {"and", "or", "but"}, "PART": {"not", "no"}, "INTJ": {"hello", "yes", "ok"},
}
SUFFIXES = (("ly$", "ADV"), ("(ing|ed)$", "VERB"), ("(able|ous|ful)$", "ADJ"), ("(tion|ment|ness)$", "NOUN"))


def pos_tag(token: Column, closed: dict[str, set[str]], gazetteer: dict[str, str] | None = None, canon: Column | None = None, suffixes=SUFFIXES, verb_ends: str | None = None, lang: Column | None = None, index: Column | None = None) -> Column:
    """The class of a token, by its lower-case form and then, if given, by its canonical one.

    ``verb_ends`` are endings that make a verb where ``lang``, a condition, holds. With ``index``, the
    token's place in its turn, a first word's capital says nothing, capitals throughout are a name, and
    what is left without being letters is X."""
    low = F.lower(token)
    out = F.when(~token.rlike("[A-Za-z0-9]"), "PUNCT").when(token.rlike("^[0-9]"), "NUM")
    for form in [low] + ([canon] if canon is not None else []):
        for tag, words in closed.items():
            out = out.when(form.isin(*sorted(words)), tag)
    for word, tag in (gazetteer or {}).items():
        out = out.when(low == word, tag)
    if verb_ends and lang is not None:
        out = out.when(lang & low.rlike(verb_ends), "VERB")
    for pattern, tag in suffixes:
        out = out.when(low.rlike(pattern), tag)
    if index is not None:
        out = out.when((index > 0) & token.rlike(r"^\p{Lu}\p{Ll}+$"), "PROPN").when(token.rlike(r"^\p{Lu}{2,}$"), "PROPN")
        return out.when(~low.rlike(r"^\p{L}+$"), "X").otherwise("NOUN")
    return out.when(token.rlike("^[A-Z][a-z]"), "PROPN").otherwise("NOUN")


def distribution(tagged: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, n) for all fifteen classes, absent ones 0."""
    dim = tagged.sparkSession.createDataFrame([(t,) for t in TAGS], "tag string")
    return dim.join(tagged.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n")), "tag", "left").na.fill(0, ["n"])
