"""Text functions: the comparison form of a text, its tokens and shingles, hashes, domains, sentences."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that don't count in a title.
STOPWORDS = (
    "the a an of in on and or to for is are was were with by at as from that this it its "
    "og i af til med er en et den det som på der die das und von im des le la les de du el los las y que"
).split()
#: Shortest comparison form that is hashed.
HASHED_LENGTH = 40
#: Words of a shingle.
SHINGLE = 5

_MARKED = re.compile(r"[^\w\s]")
_HIGH = re.compile("[^\x00-\u02ff]+")


def without_marks(text: str) -> str:
    """Decomposed by compatibility, without combining characters (none of which lies below U+0300)."""
    if text.isascii():
        return text
    return _HIGH.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), unicodedata.normalize("NFKD", text))


def comparison_form(text: str | None) -> str:
    """Lower case, without marks and punctuation, single blanks; '' for null."""
    if not text:
        return ""
    return " ".join(_MARKED.sub(" ", without_marks(text).lower()).split())


@F.pandas_udf(T.StringType())
def normalise(text: pd.Series) -> pd.Series:
    """``comparison_form`` of a column (decomposition of compatibility characters has no built-in)."""
    return text.map(comparison_form, na_action=None).fillna("") if len(text) else text


def body_hash(form: Column) -> Column:
    """Hash of a comparison form; null where it is too short to stand for a body."""
    return F.when(F.length(form) >= HASHED_LENGTH, F.sha2(form, 256))


def words_of(form: Column) -> Column:
    return F.filter(F.split(form, " "), lambda w: w != "")


def title_tokens(form: Column) -> Column:
    """Distinct words of a comparison form without stopwords."""
    return F.array_distinct(F.filter(F.split(form, " "), lambda w: (w != "") & ~w.isin(*STOPWORDS)))


def shingles(form: Column, size: int = SHINGLE) -> Column:
    """Distinct runs of ``size`` words; a shorter text is one run, an empty one none."""
    w = words_of(form)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two sets' union that both have; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def word_count(text: Column) -> Column:
    """Words by white space; null for null or empty, 0 for blank."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(text != "", F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " "))))


def domain_of(url: Column) -> Column:
    """Bare lower-case host of a URL or of any name: no scheme, path, query, user, port or leading www."""
    rest = F.regexp_replace(F.trim(url), r"^.*?//", "")
    host = F.element_at(F.split(F.split(F.split(rest, "/")[0], r"\?")[0], "@"), -1)
    host = F.regexp_replace(F.lower(F.split(host, ":")[0]), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def slug(name: Column) -> Column:
    """Lower-case letters and digits joined by hyphens, at most 80 characters; ``campaign`` for nothing."""
    joined = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-")
    trimmed = F.regexp_replace(F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, 80), "-+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "campaign").otherwise(trimmed)


def clean(value: Column) -> Column:
    """Trimmed; null where nothing is left."""
    return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit(""))


_ENDS = (". ", "! ", "? ", "\n")


def sentence_around(text: str | None, at: int, longest: int = 400) -> str:
    """The sentence of ``text`` in which offset ``at`` lies, its blanks drawn together."""
    if not text:
        return ""
    at = max(0, at)
    left = max((text.rfind(e, 0, at) for e in _ENDS), default=-1)
    right = min((i for e in _ENDS if (i := text.find(e, at)) >= 0), default=-1)
    return " ".join(text[left + 1 : right + 1 if right >= 0 else len(text)].split())[:longest]
