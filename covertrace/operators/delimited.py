"""Delimited records: structural index of quotes and delimiters, header reading, reasoned rejects."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.operators.fields import FIELD_OF, field_key

DELIMITERS = ",;\t|"
QUOTE = 34
#: Characters of headers that are broadcast, at most.
HEADERS_BROADCAST = 32_000_000
# English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_OF = {m: i + 1 for i, m in enumerate(MONTHS)} | {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9}
_TIME = r"(?:[T ,]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})?)?"
_ISO = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})" + _TIME)
_SLASH = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4})" + _TIME)
_NAMED = re.compile(r"(\d{1,2}) ([A-Za-z]+)\.? (\d{4})" + _TIME)


def is_full_date(text: str) -> bool:
    """Whether ``text`` is a calendar date in one of the accepted forms (ISO, day-first slashes, day month-name year)."""
    text = text.strip()
    if m := _ISO.fullmatch(text):
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
    elif m := _SLASH.fullmatch(text):
        y, mo, d = int(m[3]), int(m[2]), int(m[1])
    elif m := _NAMED.fullmatch(text):
        y, mo, d = int(m[3]), MONTH_OF.get(m[2].lower(), 0), int(m[1])
    else:
        return False
    try:
        date(y, mo, d)
    except ValueError:
        return False
    return True


def unquote(cell: str) -> str:
    """The value of a cell that has passed the quoting check."""
    if len(cell) >= 2 and cell[0] == '"':
        return cell[1:-1].replace('""', '"')
    return cell


def scan_cells(record: bytes, delimiter: int) -> list[tuple[int, int]] | None:
    """Cell bounds of one record by a sequential scan; None where its quoting is broken.

    A quote mark that doesn't open its cell is an ordinary character.
    """
    cells, at, n = [], 0, len(record)
    mark = bytes([delimiter])
    while True:
        if at < n and record[at] == QUOTE:
            end = at + 1
            while True:
                end = record.find(b'"', end)
                if end < 0:
                    return None
                if end + 1 < n and record[end + 1] == QUOTE:
                    end += 2
                    continue
                break
            end += 1
            if end < n and record[end] != delimiter:
                return None
        else:
            end = record.find(mark, at)
            end = n if end < 0 else end
        cells.append((at, end))
        if end >= n:
            return cells
        at = end + 1


class StructuralIndex:
    """Delimiters and cells of a batch of records.

    Quote marks give a mask, its running sum within a record a parity; a delimiter counts where the parity is
    even. A record whose marks all open at a cell's start and close at its end is indexed in this way; others
    (a lone mark in an unquoted cell, an odd number, text after a closing mark) go through ``scan_cells``.
    """

    def __init__(self, records: list[str], delimiters: np.ndarray):
        raw = [r.encode("utf-8", "surrogatepass") for r in records]
        self.raw = raw
        lengths = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        buf = np.frombuffer(b"".join(raw), np.uint8)
        owner = np.repeat(np.arange(len(raw)), lengths)
        quotes = buf == QUOTE
        running = np.cumsum(quotes)
        before = running - quotes
        base = np.concatenate([[0], running])[self.starts[:-1]] if len(raw) else np.zeros(0, np.int64)
        inside_before = (before - base[owner]) & 1
        is_mark = buf == delimiters[owner]
        at = np.flatnonzero(is_mark & (inside_before == 0))
        self.delimiter_at, self.delimiter_owner = at, owner[at]
        self.counts = np.bincount(self.delimiter_owner, minlength=len(raw)) + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts - 1)])
        q = np.flatnonzero(quotes)
        own = owner[q]
        opening = inside_before[q] == 0
        at_start = q == self.starts[own]
        at_end = q + 1 == self.starts[own + 1]
        previous = np.maximum(q - 1, 0)
        following = np.minimum(q + 1, max(len(buf) - 1, 0))
        opens_well = at_start | is_mark[previous] | (buf[previous] == QUOTE)
        closes_well = at_end | is_mark[following] | (buf[following] == QUOTE)
        odd = (np.bincount(own, minlength=len(raw)) & 1).astype(bool)
        bad = np.where(opening, ~opens_well, ~closes_well)
        odd |= np.bincount(own, weights=bad, minlength=len(raw)) > 0
        self.scanned = {int(i): scan_cells(raw[i], int(delimiters[i])) for i in np.flatnonzero(odd)}

    def bounds(self, i: int) -> list[tuple[int, int]] | None:
        """Cell bounds of record ``i`` within its bytes; None where its quoting is broken."""
        if i in self.scanned:
            return self.scanned[i]
        cuts = (self.delimiter_at[self.first[i] : self.first[i + 1]] - self.starts[i]).tolist()
        return list(zip([0, *(c + 1 for c in cuts)], [*cuts, len(self.raw[i])]))

    def cells(self, i: int) -> list[str] | None:
        """Unquoted cells of record ``i``; None where its quoting is broken."""
        found = self.bounds(i)
        return None if found is None else [unquote(self.raw[i][a:b].decode("utf-8", "surrogatepass")) for a, b in found]


def clean_record(line: str | None) -> str:
    """A record without the line end that the split may have left."""
    return (line or "").rstrip("\r\n")


def header_delimiter(line: str) -> str:
    """The delimiter of a header: the candidate standing most often outside quote marks."""
    outside = re.sub(r'"(?:[^"]|"")*"', "", line)
    return max(DELIMITERS, key=outside.count)


def read_header(line: str | None) -> tuple[str, list[str]]:
    """Delimiter and comparison names of a header record."""
    text = clean_record(line).replace("﻿", "")
    mark = header_delimiter(text)
    index = StructuralIndex([text], np.array([ord(mark)], np.uint8))
    cells = index.cells(0)
    return mark, [field_key(c) for c in (cells if cells is not None else text.split(mark))]


def with_headers(lines: DataFrame, key: str = "import_id") -> DataFrame:
    """``lines`` with the header record of their file in ``__header``; header records themselves are dropped.

    Headers are one short record a file; up to ``HEADERS_BROADCAST`` characters of them are broadcast, so that no record moves. Beyond,
    the sort-merge join is split by AQE where one file holds much of the data.
    """
    header = lines.where(F.col("line_no") == 1).groupBy(F.col(key).alias("__file")).agg(F.min("raw_line").alias("__header"))
    if (header.agg(F.sum(F.length("__header") + 16)).first()[0] or 0) <= HEADERS_BROADCAST:
        header = F.broadcast(header)
    return lines.where(~F.col("line_no").eqNullSafe(1)).join(header, lines[key] == header["__file"], "left").drop("__file")


REJECT_COLUMNS = "line_id long, import_id long, reason string, headline string, published_at string, url string, outlet_name string"


def parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per record: the first failing check in ``reason`` (null: loaded) and the main fields where they can be read."""
    headers: dict[str | None, tuple[str, list[str], dict[str, int]]] = {}
    for pdf in batches:
        plans = []
        for h in pdf["__header"]:
            h = None if pd.isna(h) else h
            if h not in headers:
                mark, names = read_header(h)
                places: dict[str, int] = {}
                for k, n in enumerate(names):
                    places.setdefault(FIELD_OF.get(n, ""), k)
                headers[h] = (mark, names, places)
            plans.append((h is not None, *headers[h]))
        lines = [clean_record(None if pd.isna(x) else x) for x in pdf["raw_line"]]
        index = StructuralIndex(lines, np.fromiter((ord(p[1]) for p in plans), np.uint8, len(plans)))
        rows = []
        for i, (known, _, names, places) in enumerate(plans):
            cells = index.cells(i)
            values: dict[str, str] = {}
            if cells is None:
                reason = "quoting"
            elif not known or len(cells) != len(names):
                reason = "column_count"
            else:
                values = {f: cells[places[f]].strip() for f in ("headline", "published_at", "url", "outlet_name") if f in places}
                if not values.get("headline"):
                    reason = "headline"
                elif not is_full_date(values.get("published_at", "")):
                    reason = "publication_date"
                elif not values.get("outlet_name") and not values.get("url"):
                    reason = "outlet"
                else:
                    reason = None
            rows.append((reason, *(values.get(f) or None for f in ("headline", "published_at", "url", "outlet_name"))))
        out = pd.DataFrame(rows, columns=["reason", "headline", "published_at", "url", "outlet_name"])
        out.insert(0, "import_id", pdf["import_id"].to_numpy())
        out.insert(0, "line_id", pdf["line_id"].to_numpy())
        yield out


def parse_delimited(lines: DataFrame) -> DataFrame:
    """Every record of ``lines`` (line_id, import_id, line_no, raw_line), read or rejected.

    ``reason`` is the first that applies of ``quoting``, ``column_count``, ``headline``, ``publication_date`` and
    ``outlet``, null for a row that loads. Headers (line_no 1) are no records. A null record is an empty one; a
    file without a header fails on ``column_count``; records sent twice are two records; other columns of
    ``lines`` are ignored; an empty table gives an empty result.
    """
    wanted = lines.select("line_id", "import_id", "line_no", "raw_line")
    return with_headers(wanted).select("line_id", "import_id", "raw_line", "__header").mapInPandas(parse_batches, REJECT_COLUMNS)


def rejected_records(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the records that fail."""
    return parse_delimited(lines).where(F.col("reason").isNotNull()).select("line_id", "reason")


def loaded_records(lines: DataFrame) -> DataFrame:
    """The records that load, with their main fields."""
    return parse_delimited(lines).where(F.col("reason").isNull()).drop("reason")


def rejection_report(lines: DataFrame) -> DataFrame:
    """Counts by file and reason; loaded rows stand under ``loaded``."""
    return parse_delimited(lines).groupBy("import_id", F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("n_rows"))
