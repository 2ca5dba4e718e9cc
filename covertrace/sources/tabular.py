"""Delimited exports: delimiter and columns told from the header, canonical rows by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertrace.operators.delimited import header_delimiter, read_header

# Header spellings by canonical field, in the order in which they are preferred.
HINTS = {
    "headline": ("headline", "title", "head", "overskrift", "rubrik", "article title", "hd"),
    "published_at": ("published_at", "published", "date", "publication date", "pubdate", "dato", "publiceret", "publication_date", "pd", "datetime"),
    "url": ("url", "link", "web url", "article url", "permalink", "an_url"),
    "outlet_name": ("outlet", "outlet_name", "source", "publication", "media", "medie", "source name", "sn", "kilde"),
    "outlet_domain": ("domain", "outlet_domain", "host", "hostname", "website", "site"),
    "country": ("country", "land", "country code", "re", "region"),
    "language": ("language", "lang", "sprog", "la"),
    "byline": ("byline", "author", "journalist", "forfatter", "by", "reporter"),
    "body_text": ("body", "body_text", "text", "content", "full text", "fulltext", "article text", "brødtekst", "lp", "td"),
}
# The same for the Danish media archive, with what its rows lack.
DANISH_HINTS = {
    "headline": ("overskrift", "rubrik", "headline", "titel", "title"),
    "published_at": ("dato", "publiceringsdato", "publiceret", "date", "publication date"),
    "url": ("url", "link", "webadresse", "artikel-url"),
    "outlet_name": ("medie", "kilde", "medienavn", "source", "media", "publication"),
    "outlet_domain": ("domæne", "domain", "website", "hjemmeside"),
    "byline": ("forfatter", "journalist", "byline", "author"),
    "body_text": ("brødtekst", "tekst", "indhold", "body", "text", "artikeltekst"),
    "language": ("sprog", "language"),
    "country": ("land", "country"),
}
DANISH_DEFAULTS = {"country": "DK", "language": "da", "outlet_tier": "national_general"}
REQUIRED = ("headline", "published_at")


def guess_mapping(headers: list[str], hints: dict[str, tuple[str, ...]] = HINTS) -> dict[str, str]:
    """Canonical field to column, by the first spelling that a header has; unmapped fields are left out."""
    known = {h.replace("﻿", "").strip().lower(): h for h in reversed(headers) if h}
    return {field: known[name] for field, names in hints.items() for name in [next((n for n in names if n in known), None)] if name}


def inspect(spark: SparkSession, path: str, hints: dict[str, tuple[str, ...]] = HINTS) -> dict:
    """Delimiter, headers, mapping and first row of a file, without an import."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    mark = header_delimiter(line)
    df = _csv(spark, path, mark)
    mapping = guess_mapping(df.columns, hints)
    first = df.limit(1).collect()
    return {
        "delimiter": mark, "headers": df.columns, "mapping": mapping, "unmapped": [f for f in hints if f not in mapping],
        "sample": first[0].asDict() if first else None, "required_present": all(f in mapping for f in REQUIRED), "names": read_header(line)[1],
    }


def _csv(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    return reader.csv(path)


def read_delimited(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, defaults: dict[str, str] | None = None, hints: dict[str, tuple[str, ...]] = HINTS) -> DataFrame:
    """Canonical rows of a delimited file; the required fields must be mapped."""
    found = inspect(spark, path, hints)
    mapping = mapping or found["mapping"]
    if missing := [f for f in REQUIRED if f not in mapping]:
        raise ValueError(f"no column for {', '.join(missing)}")
    df = _csv(spark, path, found["delimiter"])
    columns = [F.col(f"`{c}`").alias(f) for f, c in mapping.items()]
    out = df.select(*columns)
    for field, value in (defaults or {}).items():
        out = out.withColumn(field, F.coalesce(F.col(field), F.lit(value)) if field in mapping else F.lit(value))
    return out
