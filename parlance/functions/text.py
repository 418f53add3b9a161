"""Text functions as Catalyst expressions. Vocabularies are parameters, never code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers with separators, ASCII words with an inner apostrophe, any other single character.
TOKEN = r"\d+(?:[.,]\d+)*|[A-Za-z]+(?:'[A-Za-z]+)?|[^\sA-Za-z\d]"

# The spelling rules that are tried before a dictionary look-up, in order.
SQUEEZES = (("aa+", "a"), ("ee+", "i"), ("oo+", "u"), ("ii+", "i"), ("uu+", "u"), (r"(.)\1{2,}", "$1"))


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """The tokens of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(column(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def lowered(words: Column) -> Column:
    return F.transform(words, F.lower)


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")


def canonical(token: Column, variants: dict[str, str], known: set[str] | list[str]) -> Column:
    """A token's dictionary spelling: a variant's canon, else squeezed and looked up, else itself."""
    t = F.trim(F.lower(token))
    table = literal_map(variants)
    squeezed = reduce(lambda c, r: F.regexp_replace(c, *r), SQUEEZES, t)
    known_squeezed = F.when(F.array_contains(F.array(*[F.lit(k) for k in sorted(known)]), squeezed), squeezed) if known else F.lit(None).cast("string")
    return F.coalesce(F.try_element_at(table, t), F.try_element_at(table, squeezed), known_squeezed, t)


def token_language(token: Column, vocabulary: dict[str, set[str]], universal: set[str] = frozenset(), patterns: dict[str, list[str]] | None = None, variants: dict[str, str] | None = None) -> Column:
    """The language of one token, of two named ones, or ``univ``.

    Tokens with other than letters and the universal words are ``univ``; then the word lists, in the
    vocabulary's order; then the lists by canonical spelling; then the larger number of spelling
    patterns that fit; a tie is ``univ``.
    """
    (a, words_a), (b, words_b) = vocabulary.items()
    patterns = patterns or {}
    t = F.trim(F.lower(token))

    def among(c: Column, words) -> Column:
        return c.isin(*sorted(words)) if words else F.lit(False)

    out = F.when(~t.rlike(r"^\p{L}+$"), "univ").when(among(t, universal), "univ").when(among(t, words_a), a).when(among(t, words_b), b)
    if variants:
        c = canonical(token, variants, words_a | words_b)
        out = out.when(among(c, words_a), a).when(among(c, words_b), b)
    votes = [reduce(lambda x, y: x + y, [F.when(t.rlike(p), 1).otherwise(0) for p in patterns.get(k, [])], F.lit(0)) for k in (a, b)]
    return out.when(votes[0] > votes[1], a).when(votes[1] > votes[0], b).otherwise("univ")


def collapse_repeats(text: Column) -> Column:
    """Three or more of one character become two."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def word_shape(token: Column) -> Column:
    """X for upper case, x for lower, d for digits; runs of three or more become two."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[A-Z]", "X"), "[a-z]", "x"), "[0-9]", "d")
    return collapse_repeats(shape)


def is_digit_run(token: Column, least: int = 4) -> Column:
    return token.rlike(rf"^[0-9]{{{least},}}$")


def clean_markup(text: Column) -> Column:
    """Tags out, ampersands to words, blanks to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "&", " and "), r"\s+", " "))


def gazetteer_type(token: Column, gazetteer: dict[str, str], canon=None) -> Column:
    """The type that a word list gives a token, by its lower-case or its canonical form; null if none."""
    table, low = literal_map(gazetteer), F.lower(token)
    found = F.try_element_at(table, low)
    return found if canon is None else F.coalesce(found, F.try_element_at(table, canon(token)))


def first_types(lists: list[tuple[str, set[str]]]) -> dict[str, str]:
    """One type for each word of some typed lists: of several the first list's."""
    out: dict[str, str] = {}
    for kind, words in lists:
        for w in sorted(words):
            out.setdefault(w, kind)
    return out


def word_density(words: Column, terms: set[str], canon=None, least: int = 3) -> Column:
    """How many of a hundred tokens are words of ``least`` letters or more of some terms, as they stand
    or by their canonical form; without tokens 0."""
    table = sorted({w for t in terms for w in t.split() if len(w) >= least})
    hit = lambda w: F.lower(w).isin(*table) | (canon(w).isin(*table) if canon else F.lit(False))
    return F.when(F.size(words) > 0, 100.0 * F.size(F.filter(words, hit)) / F.size(words)).otherwise(0.0)


# Characters that no blank stands before, and behind.
HUGS_LEFT, HUGS_RIGHT = ",.?!;:)]}%@", "([{@"


def detokenize(words: Column) -> Column:
    """Tokens as text: punctuation hugs the word to its left, brackets and @ both sides."""
    left, right = (F.array(*[F.lit(c) for c in cs]) for cs in (HUGS_LEFT, HUGS_RIGHT))
    bound = lambda w, i: (i == 0) | F.array_contains(left, w) | F.coalesce(F.array_contains(right, F.get(words, i - 1)), F.lit(False))
    return F.array_join(F.transform(words, lambda w, i: F.when(bound(w, i), w).otherwise(F.concat(F.lit(" "), w))), "")


def ngrams(words: Column, n: int, joint: str = "_") -> Column:
    """The n-grams of an array, joined."""
    whole = F.size(words) - (n - 1)
    return F.when(whole < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), joint)))


def sentences(text: Column, least_words: int = 2) -> Column:
    """Parts behind . ! ?, of two words or more; the whole text if there is none."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least_words)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def finite(x: Column, default: float = 0.0) -> Column:
    """The number, or the default where it is null, NaN or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -40.0, 40.0)))
