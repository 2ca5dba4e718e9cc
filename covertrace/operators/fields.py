"""Names under which files deliver the same field."""

from __future__ import annotations

# Field names of delivered files, by the field they stand for.
ALIASES: dict[str, tuple[str, ...]] = {
    "headline": ("headline", "title", "article title", "rubrik", "overskrift", "heading"),
    "published_at": ("date", "publication date", "pubdate", "published", "dato", "published_at", "publish date"),
    "url": ("url", "link", "web url", "permalink", "web address"),
    "outlet_name": ("source", "outlet", "medie", "publication", "media", "outlet_name", "newspaper"),
    "outlet_domain": ("domain", "host", "website", "site", "outlet_domain"),
    "country": ("country", "land", "country code"),
    "language": ("language", "lang", "sprog"),
    "byline": ("author", "byline", "journalist", "reporter", "forfatter"),
    "body_text": ("body", "content", "full text", "brødtekst", "text", "body_text"),
    "paywall": ("paywall", "subscriber only", "locked"),
    "section": ("section", "category", "sektion"),
    "shares": ("shares", "delinger", "reposts"),
    "edition": ("edition", "udgave", "issue"),
    "words": ("words", "word count", "ordantal", "length"),
    "reach": ("reach", "circulation", "audience"),
    "score": ("score", "relevance", "match"),
    "page": ("page", "page no", "side"),
}

FIELD_OF: dict[str, str] = {alias: field for field, names in ALIASES.items() for alias in names}


def field_key(name: str | None) -> str:
    """The comparison form of a field name: no byte-order mark, no outer blanks, lower case."""
    return (name or "").replace("﻿", "").strip().lower()
