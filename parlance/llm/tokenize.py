"""Byte-level BPE ids of whole texts with the tokenizers library, piece by piece.

The vocabulary's pattern always begins a new piece before the last blank of a run of white space, so
a text may be cut before each single space and its pieces encoded on their own. Pieces recur, so
their ids are kept in tables of bounded size, and the library's model sees a piece once per fill.
Texts in which a space touches another space, or that end with one, are cut by the whole pattern;
what holds letters beyond the Latin ones goes through the library's own cutting. A text that holds
an added token's string (such as ``<|endoftext|>``, which gets that token's id) goes through it whole,
and so does every text where the tokenizer's file asks for another cutting than this.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

DEFAULT = "byte_bpe_50k.json"
_LATIN = 0x250
#: Pieces that a worker keeps the ids of, at some 160 bytes each.
HELD = 3 << 18
_TYPE = {"H": 2, "I": 4}


def tokenizer_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _pattern() -> re.Pattern:
    """The byte-level vocabulary's pattern for texts of characters below U+0250."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(_LATIN)):
        kinds.get(unicodedata.category(c)[0], []).append(c)
    letter, number = "".join(kinds["L"]), "".join(kinds["N"])
    blank = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _plain(file: dict) -> bool:
    """Whether a tokenizer's file is a byte-level vocabulary with the usual pattern and no more."""
    cut, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    odd = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback")
    return bool(usual and not file.get("normalizer") and not file.get("truncation") and model.get("type") == "BPE" and not odd)


class _Held(dict):
    """What ``make`` gives for a key, kept until there are more than ``most`` keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Texts to ids as little-endian unsigned numbers of two bytes ("H") or four ("I")."""

    def __init__(self, path: str, kind: str = "H", most: int = HELD):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if kind == "H" and self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need four bytes")
        if array(kind).itemsize != _TYPE[kind]:
            raise ValueError("this platform's integers have another width")
        self.kind, self.model, self.plain = kind, self.library.model, _plain(json.loads(self.library.to_str()))
        self.cut, self.names = _pattern().findall, _byte_names()
        added = list(self.library.get_added_tokens_decoder().values())
        loose = any(t.normalized for t in added) and self.library.normalizer is not None
        # what an added token may match: its string, or anything where the library rewrites texts first
        self.added = re.compile("" if loose else "|".join(re.escape(t.content) for t in added)).search if added else lambda text: None
        self.words = _Held(self._word, most)
        self.first = _Held(self._piece, most)
        self.later = _Held(self._later, most)

    def _ids(self, ids) -> bytes:
        return array(self.kind, ids).tobytes()

    def _word(self, word: str) -> bytes:
        """One piece of the pattern, by the library's model."""
        return self._ids([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.names))])

    def _later(self, piece: str) -> bytes:
        """A piece with a space before it. Its words are kept here too, so each is held once."""
        if piece.isascii() and piece.isalpha():  # a single piece of the pattern
            return self._word(" " + piece)
        return self._piece(" " + piece)

    def _piece(self, text: str) -> bytes:
        if text.isascii() or max(text) < chr(_LATIN):
            parts = self.cut(text)
            if len(parts) == 1:
                return self._word(text)
            return b"".join([self.later[p[1:]] if len(p) > 1 and p[0] == " " else self.words[p] for p in parts])
        return self._ids(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text in their byte form; a null is empty."""
        if not text:
            return b""
        if not self.plain or self.added(text):
            return self._ids(self.library.encode(text, add_special_tokens=False).ids)
        if "  " in text or text[-1] == " ":
            return self._piece(text)
        pieces = text.split(" ")
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))

    def exact(self, texts: list[str]) -> list[bytes]:
        """The same by the library alone, without tables."""
        return [self._ids(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, kind: str = "H", most: int = HELD) -> Encoder:
    """One encoder for each worker process."""
    key = path, kind, most
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, kind, most)
    return _encoders[key]
