"""Romanised words to ITRANS and ITRANS to Devanagari, as column expressions.

A text is cut at ASCII white space and joined by single blanks. A word is transliterated when, without
the marks ``MARKS`` at its ends, it consists of letters and is not one of the words to keep; its marks,
wherever they stood, follow it. Null gives null, an empty text stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import literal_map

MARKS = ".,!?;:"
# Spellings that stand for one ITRANS letter, applied in this order.
SPELLINGS = (("aa", "A"), ("ee", "I"), ("ii", "I"), ("oo", "U"), ("uu", "U"), ("ck", "k"), ("x", "ks"), ("z", "j"), ("w", "v"), ("chh", "Ch"), ("ss", "s"), ("tt", "T"), ("dd", "D"))
LONG_ENDS = "aAiIuUeoEO"
# The ITRANS scheme. Vowels: the letter that stands alone and the sign behind a consonant.
VOWELS = {
    "a": ("अ", ""), "A": ("आ", "ा"), "i": ("इ", "ि"), "I": ("ई", "ी"), "u": ("उ", "ु"), "U": ("ऊ", "ू"), "RRi": ("ऋ", "ृ"), "RRI": ("ॠ", "ॄ"),
    "e": ("ए", "े"), "E": ("ए", "े"), "ai": ("ऐ", "ै"), "o": ("ओ", "ो"), "O": ("ओ", "ो"), "au": ("औ", "ौ"),
}
CONSONANTS = {
    "k": "क", "kh": "ख", "g": "ग", "gh": "घ", "~N": "ङ", "c": "च", "ch": "च", "Ch": "छ", "j": "ज", "jh": "झ", "~n": "ञ", "T": "ट", "Th": "ठ", "D": "ड", "Dh": "ढ", "N": "ण",
    "t": "त", "th": "थ", "d": "द", "dh": "ध", "n": "न", "p": "प", "ph": "फ", "b": "ब", "bh": "भ", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व",
    "sh": "श", "Sh": "ष", "s": "स", "h": "ह", "L": "ळ", "q": "क़", "f": "फ़", "R": "ऱ",
}
SIGNS = {"M": "ं", "H": "ः", ".N": "ँ"}
VIRAMA = "्"
#: One unit of ITRANS: the longest name that fits, or any other character.
UNIT = "(" + "|".join(sorted([*VOWELS, *CONSONANTS, *SIGNS], key=lambda k: (-len(k), k))).replace(".", r"\.") + "|.)"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_itrans(word: Column, pinned: dict[str, str] | None = None) -> Column:
    """A lower-case word by its pinned spelling or by ``SPELLINGS``. A last a is long, and a word that
    ends in a consonant gets the vowel that the script implies."""
    out = word
    for spelling, letter in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(letter))
    out = F.regexp_replace(F.regexp_replace(out, "a$", "A"), f"([^{LONG_ENDS}])$", "$1a")
    return F.coalesce(F.try_element_at(literal_map(pinned), word), out) if pinned else out


def itrans_to_devanagari(word: Column) -> Column:
    """Units from left to right, the longest first. A consonant carries the sign of the vowel behind it and
    a virama where none follows; a vowel behind no consonant stands alone. Whether either holds is read
    from the neighbouring unit, so a word takes one linear pass. Other characters stay."""
    letters, alone, behind, signs = (literal_map(x) for x in (CONSONANTS, {k: v for k, (v, _) in VOWELS.items()}, {k: v for k, (_, v) in VOWELS.items()}, SIGNS))
    is_consonant = lambda u: F.coalesce(u.isin(*CONSONANTS), F.lit(False))
    is_vowel = lambda u: F.coalesce(u.isin(*VOWELS), F.lit(False))

    def written(units):
        def one(u, i):
            carried = F.concat(F.try_element_at(letters, u), F.when(is_vowel(F.get(units, i + 1)), F.lit("")).otherwise(F.lit(VIRAMA)))
            vowel = F.when(is_consonant(F.get(units, i - 1)), F.try_element_at(behind, u)).otherwise(F.try_element_at(alone, u))
            return F.when(is_consonant(u), carried).when(is_vowel(u), vowel).otherwise(F.coalesce(F.try_element_at(signs, u), u))

        return F.array_join(F.transform(units, one), "")

    return _let(F.regexp_extract_all(word, F.lit(UNIT), F.lit(1)), written)


def to_devanagari(text: Column, keep: set[str] | None = None, pinned: dict[str, str] | None = None) -> Column:
    """Romanised text in Devanagari; words of ``keep`` and all that is not made of letters stay as they are."""
    ends = "[" + MARKS + "]"

    def word(token):
        def of(core):
            stays = ~core.rlike(r"^\p{L}+$")
            if keep:
                stays = stays | core.isin(*sorted(keep))
            return F.when(stays, token).otherwise(F.concat(itrans_to_devanagari(to_itrans(core, pinned)), F.regexp_replace(token, f"[^{MARKS}]", "")))

        return _let(F.lower(F.regexp_replace(token, f"^{ends}+|{ends}+$", "")), of)

    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.array_join(F.transform(words, word), " ")
