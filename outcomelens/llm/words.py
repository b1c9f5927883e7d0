"""Words of a text, compared without layout, letter case, punctuation, markup and escapes. In scripts that are written without
spaces between words every character is a word."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
#: Thai, Lao, Burmese, Khmer, Kana and Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_MIXED = re.compile(rf"(?![\W_])[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W_])+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_CONTROL = re.compile(r"\\[nrt]")
#: What ends a sentence, a line or (with two line ends) a paragraph.
_END = r"[.!?](?=\s)|[。！？]|(?:\r?\n[ \t]*)+|\r"
_PIECE, _MIXED_PIECE = re.compile(rf"{WORD.pattern}|{_END}"), re.compile(rf"{_MIXED.pattern}|{_END}")
_HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


def _mixed(text: str) -> bool:
    return not text.isascii() and _ANY_UNSPACED.search(text) is not None


def plain_words(text: str | None) -> list[str]:
    """Case-folded runs of letters and digits; an empty list for null."""
    if not text:
        return []
    text = text.casefold()
    return (_MIXED if _mixed(text) else WORD).findall(text)


def plain_pieces(text: str | None) -> list[str]:
    """The same words with the ends of sentences, lines and paragraphs between them."""
    if not text:
        return []
    text = text.casefold()
    return (_MIXED_PIECE if _mixed(text) else _PIECE).findall(text)


def bare_words(text: str | None) -> list[str]:
    """The same after undoing entities, escapes, tags and invisible characters."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _CONTROL.sub(" ", _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_HIDDEN))
    return plain_words(text)


_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Known(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Hashes:
    """64-bit hashes of words, computed once a word, and of the word n-grams of a text."""

    def __init__(self) -> None:
        self.known: dict[str, int] = _Known()

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 1_000_000:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def grams(self, words: list[str], n: int) -> np.ndarray:
        return self.roll(self.words(words), n)

    @staticmethod
    def roll(codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n-grams of words given by their hashes."""
        if len(codes) < n:
            return np.empty(0, np.int64)
        value = codes[: len(codes) - n + 1].copy()
        with np.errstate(over="ignore"):
            for k in range(1, n):
                value = (value ^ (value >> np.uint64(29))) * _MIX + codes[k : len(codes) - n + 1 + k]
        return value.view(np.int64)
