"""Rare tokens of a text: hashed word runs at the edges of its sentences, equal across settings, marks and encodings."""

from __future__ import annotations

import re

import xxhash

from covertrace.llm.fold import _ALIKE, _ALIKE_SEEN, _TAG

#: Words of a token.
RUN = 5
_SPACES = re.compile(r"[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_KEPT = b"bcdfghjklmnpqrstvwxz0123456789.!? \t\n\r\f\v"
_DROPPED = bytes(c for c in range(128) if c not in _KEPT)
_GROUPS = re.compile(r"\.(?<=[0-9]\.)(?=[0-9])")
_ENDS = re.compile(r"[.!?…]+(?:\s+|$)|\n+")
_JOINT = re.compile(r"(?<=\w)[-‐]\n(?=\w)")


def skeleton(text: str | None) -> str:
    """Consonants and digits of a text, with its white space and sentence ends.

    Vowels and letters beyond ASCII are left out, so that a word reads alike with its marks, without them, and
    with its letters wrongly decoded.
    """
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii() and _ALIKE_SEEN.search(text):
        text = text.translate(_ALIKE)
    if "-\n" in text:
        text = _JOINT.sub("", text)
    if not text.isascii():
        text = _SPACES.sub(" ", text.replace("…", "..."))
    return _GROUPS.sub("", text.lower().encode("ascii", "ignore").translate(None, _DROPPED).decode("ascii"))


def anchors(text: str | None) -> list[int]:
    """Distinct tokens (signed 64-bit hashes): the first and the last run of ``RUN`` words of each sentence.

    A sentence of fewer words than a run is one token with the sentence before it.
    """
    return anchors_of(skeleton(text))


def anchors_of(form: str) -> list[int]:
    """``anchors`` of a text whose skeleton is at hand."""
    found: dict[int, None] = {}
    carried: list[str] = []
    digest = xxhash.xxh3_64_intdigest
    for part in _ENDS.split(form):
        ws = part.split()
        if not ws:
            continue
        if len(ws) < RUN:
            ws = carried + ws
            if len(ws) < RUN:
                carried = ws
                continue
        carried = []
        for run in (ws[:RUN], ws[-RUN:]):
            h = digest(" ".join(run))
            found[h - (1 << 64) if h >> 63 else h] = None
    if not found and carried:
        h = digest(" ".join(carried))
        found[h - (1 << 64) if h >> 63 else h] = None
    return list(found)
