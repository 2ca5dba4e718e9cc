"""Comparison forms of text: folded strings, tokens, sentences."""

from __future__ import annotations

import html
import re
import unicodedata

_MARKS = re.compile("[̀-ͯ­​-‏⁠﻿]+")
_QUOTED = re.compile(r"^[ \t]*(?:>[ \t]?)+", re.M)
_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]{0,200}|!--[^<>]{0,200}--)>")
# patterns begin with what is rare, so that the search passes quickly over all else
_BROKEN = re.compile(r"[-‐\u00ad]\n(?<=\w[-‐\u00ad]\n)(?=\w)")
_GROUPED = re.compile(r"[,.'’\u00a0\u202f\u2009](?<=\d.)(?=\d{3}(?!\d))")
_WORD = re.compile(r"[^\W_]+")
# Letters that stand for others when marks are stripped.
_LETTERS = {"ø": "o", "æ": "ae", "ß": "ss", "œ": "oe", "đ": "d", "ł": "l", "ı": "i"}
# Cyrillic and Greek letters that look like Latin ones.
_ALIKE_SEEN = re.compile("[\u0370-\u03ff\u0400-\u04ff]")
_ALIKE = str.maketrans("АВЕКМНОРСТУХІЈЅаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXIJSaeopcyxijsABEZHIKMNOPTYXo")
# the dot after a day's number ends no sentence
_SENTENCE = re.compile(r"(?<=[.!?…])(?<!\b\d\.)(?<!\b\d\d\.)[\"”»“«’')\]]*\s+|\n+")


def fold(text: str | None) -> str:
    """Lower case without tags, marks, look-alike letters, quoting marks, broken words and digit grouping; '' for null."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain and _ALIKE_SEEN.search(text):
        text = text.translate(_ALIKE)
    text = text.lower()
    if not plain:
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        for letter, other in _LETTERS.items():
            text = text.replace(letter, other)
    if "\n" in text:
        text = _BROKEN.sub("", _QUOTED.sub("", text))
    return _GROUPED.sub("", text)


def words(text: str | None) -> list[str]:
    """Folded tokens: runs of letters and digits."""
    return _WORD.findall(fold(text))


def sentences(text: str | None) -> list[str]:
    """Sentences and lines of a text, none blank."""
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()]
