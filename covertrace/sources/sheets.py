"""Spreadsheets (xlsx): the first sheet's rows, read without a library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertrace.sources.tabular import DANISH_HINTS, REQUIRED, guess_mapping

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(reference: str) -> int:
    """Zero-based column of a cell reference such as ``AB7``."""
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as text; rows of nothing but empty cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]), default=None)
        if first is None:
            return []
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                v = c.find(f"{_NS}v")
                text = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                if c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                cells[_column(c.get("r")) if c.get("r") else k] = text or None
            if any(cells.values()):
                rows.append([cells.get(k) for k in range(max(cells) + 1)])
        return rows


def read_sheets(spark: SparkSession, path: str, hints: dict[str, tuple[str, ...]] = DANISH_HINTS, defaults: dict[str, str] | None = None) -> DataFrame:
    """Canonical rows of spreadsheets whose first row names the columns; a file is read by one task."""
    fields = list(hints)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = sheet_rows(bytes(content))
                if not rows:
                    continue
                header = [h or "" for h in rows[0]]
                mapping = guess_mapping(header, hints)
                if any(f not in mapping for f in REQUIRED):
                    raise ValueError(f"{name}: no column for a required field")
                at = {f: header.index(c) for f, c in mapping.items()}
                for k, row in enumerate(rows[1:]):
                    out.append((name, k, *(row[at[f]] if f in at and at[f] < len(row) else None for f in fields)))
            yield pd.DataFrame(out, columns=["file", "place", *fields])

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, place int, " + ", ".join(f"{f} string" for f in fields))
    for field, value in (defaults or {}).items():
        df = df.withColumn(field, F.coalesce(field, F.lit(value)) if field in fields else F.lit(value))
    return df
