"""Fields of a feed's files over time: a catalogue of field lifespans, the log of changes, one consistent table."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from covertrace.operators.delimited import StructuralIndex, clean_record, read_header, with_headers
from covertrace.operators.fields import ALIASES, FIELD_OF
from covertrace.session import written

#: A field that empty cells may leave out counts as merely unfilled in a gap whose chance, at the field's usual
#: filling, is at least this.
ACCIDENT = 0.01
# Cells that stand for nothing.
NOTHING = ("", "-", "?", "n/a", "na", "nan", "none", "null", "unknown")
_WHOLE, _DECIMAL, _FLAG = r"^[-+]?[0-9]+$", r"^[-+]?[0-9]*\.[0-9]+([eE][-+]?[0-9]+)?$", r"^(true|false)$"
_WHOLE_P, _DECIMAL_P, _FLAG_P = re.compile(_WHOLE), re.compile(_DECIMAL), re.compile(_FLAG)
_COUNTS = ("n_records", "n_present", "n_whole", "n_decimal", "n_flag", "n_text", "n_chars")
OBSERVED = "import_id long, field string, " + ", ".join(f"{c} long" for c in _COUNTS)


def _header_fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, n, *[0] * 7) for i, line in zip(pdf["import_id"], pdf["raw_line"]) for n in read_header(None if pd.isna(line) else line)[1]]
        yield pd.DataFrame(rows, columns=["import_id", "field", *_COUNTS])


def _cell_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by file and field over a batch; broken records are left out."""
    for pdf in batches:
        pdf = pdf[pdf["__header"].notna()]
        heads = {h: read_header(h) for h in pdf["__header"].unique()}
        lines = [clean_record(None if pd.isna(x) else x) for x in pdf["raw_line"]]
        index = StructuralIndex(lines, np.fromiter((ord(heads[h][0]) for h in pdf["__header"]), np.uint8, len(lines)))
        counts: dict[tuple[int, str], list[int]] = defaultdict(lambda: [0] * 7)
        for i, (file, h) in enumerate(zip(pdf["import_id"], pdf["__header"])):
            cells, names = index.cells(i), heads[h][1]
            if cells is None or len(cells) != len(names):
                continue
            for name, cell in zip(names, cells):
                c = counts[(file, name)]
                value = cell.strip().lower()
                c[0] += 1
                c[1] += 1
                if value in NOTHING:
                    continue
                c[2 if _WHOLE_P.match(value) else 3 if _DECIMAL_P.match(value) else 4 if _FLAG_P.match(value) else 5] += 1
                c[6] += len(value)
        yield pd.DataFrame([(*k, *v) for k, v in counts.items()], columns=["import_id", "field", *_COUNTS])


def observe_delimited(lines: DataFrame) -> DataFrame:
    """Field counts of delimited files from their headers and cells."""
    wanted = lines.select("import_id", "line_no", "raw_line")
    heads = wanted.where(F.col("line_no") == 1).groupBy("import_id").agg(F.min("raw_line").alias("raw_line")).mapInPandas(_header_fields, OBSERVED)
    cells = with_headers(wanted).select("import_id", "raw_line", "__header").mapInPandas(_cell_counts, OBSERVED)
    return heads.unionByName(cells).groupBy("import_id", "field").agg(*[F.sum(c).alias(c) for c in _COUNTS]).withColumn("sparse", F.lit(False))


def observe_objects(rows: DataFrame) -> DataFrame:
    """Field counts of JSON objects (``raw``); an object leaves out fields at will, so absence may be accident."""
    parsed = rows.select("import_id", F.from_json("raw", "map<string,string>").alias("o")).where(F.col("o").isNotNull())
    n = parsed.groupBy("import_id").agg(F.count("*").alias("n_records"))
    cell = parsed.select("import_id", F.explode("o").alias("k", "v")).select(
        "import_id", F.lower(F.trim(F.regexp_replace("k", "﻿", ""))).alias("field"), F.lower(F.trim("v")).alias("v")
    )
    filled = F.col("v").isNotNull() & ~F.col("v").isin(*NOTHING)
    whole, decimal, flag = (F.col("v").rlike(p) for p in (_WHOLE, _DECIMAL, _FLAG))
    counted = cell.groupBy("import_id", "field").agg(
        F.count("*").alias("n_present"),
        F.count_if(filled & whole).alias("n_whole"),
        F.count_if(filled & decimal).alias("n_decimal"),
        F.count_if(filled & flag).alias("n_flag"),
        F.count_if(filled & ~(whole | decimal | flag)).alias("n_text"),
        F.coalesce(F.sum(F.when(filled, F.length("v"))), F.lit(0)).alias("n_chars"),
    )
    return counted.join(n, "import_id").withColumn("sparse", F.lit(True))


def _kind() -> Column:
    """The type of a field in one file, that of most of its filled cells; null where none is filled.

    Single cells of another type come from records whose cells have slipped. Of equal counts the stricter type
    stands.
    """
    counts = [("n_flag", "true/false"), ("n_whole", "whole"), ("n_decimal", "decimal"), ("n_text", "text")]
    most = F.greatest(*[F.col(c) for c, _ in counts])
    kind = F.when(most == 0, None)
    for c, name in counts:
        kind = kind.when(F.col(c) == most, name)
    return kind


def field_catalogue(imports: DataFrame, observed: DataFrame) -> DataFrame:
    """Lifespan rows: each field of each file with its place in its feed and what came before.

    Files of a feed are numbered by (imported_at, id); names of one alias group are one field, unless a file of
    the feed has two of them at once. Files without any field aren't numbered.
    """
    aliases = F.create_map(*[F.lit(x) for pair in FIELD_OF.items() for x in pair])
    seen = observed.withColumn("grp", F.coalesce(aliases[F.col("field")], F.col("field")))
    sized = seen.groupBy("import_id").agg(F.max("n_records").alias("file_records"))
    files = (
        imports.select(F.col("id").alias("import_id"), F.coalesce("feed", F.lit("")).alias("feed"), "imported_at")
        .join(sized, "import_id")
        .withColumn("seq", F.row_number().over(W.partitionBy("feed").orderBy("imported_at", "import_id")))
        .withColumn("upto", F.sum("file_records").over(W.partitionBy("feed").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("next_import", F.lead("import_id").over(W.partitionBy("feed").orderBy("seq")))
        .withColumn("last_seq", F.max("seq").over(W.partitionBy("feed")))
        .withColumn("total", F.max("upto").over(W.partitionBy("feed")))
    )
    cat = seen.join(files, "import_id").withColumn("kind", _kind())
    file_group = W.partitionBy("import_id", "grp")
    cat = cat.withColumn("n_names", F.count("*").over(file_group))
    cat = cat.withColumn("doubled", F.max("n_names").over(W.partitionBy("feed", "grp")) > 1)
    cat = cat.withColumn("life", F.when(F.col("doubled"), F.col("field")).otherwise(F.col("grp")))
    line = W.partitionBy("feed", "life").orderBy("seq")
    fill = F.sum("n_present").over(W.partitionBy("feed", "life")) / F.sum("n_records").over(W.partitionBy("feed", "life"))
    return (
        cat.withColumn("fill", F.when(F.col("sparse"), fill).otherwise(F.lit(1.0)))
        .withColumn("prev_seq", F.lag("seq").over(line))
        .withColumn("prev_name", F.lag("field").over(line))
        .withColumn("prev_upto", F.lag("upto").over(line))
        .withColumn("prev_next", F.lag("next_import").over(line))
        .withColumn("prev_kind", F.last("kind", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("is_last", F.lead("seq").over(line).isNull())
    )


def drift_log(imports: DataFrame, lines: DataFrame | None, rows: DataFrame | None) -> DataFrame:
    """(import_id, change, field_name): each change of a feed's fields, at the file where it begins.

    A start is ``added``, an ending ``removed``, both at once under two names of one field ``renamed``, a new type
    of cell ``retyped`` (whole, decimal, true/false, text, by most cells; dates are left out). Names are compared trimmed and in
    lower case. Unknown names that end and start at once count as renamed where their cells have one type and
    nearly one mean length. Null or repeated rows, unreadable objects and empty tables add nothing; a null feed
    is a feed of its own.
    """
    observed = [x for x in (observe_delimited(lines) if lines is not None else None, observe_objects(rows) if rows is not None else None) if x is not None]
    seen = observed[0] if len(observed) == 1 else observed[0].unionByName(observed[1])
    cat = field_catalogue(imports, written(seen))  # every file is parsed once
    chance = lambda n: F.pow(F.greatest(1 - F.col("fill"), F.lit(0.0)), n)
    gap_rows = F.col("upto") - F.col("file_records") - F.coalesce(F.col("prev_upto"), F.lit(0))
    gap = F.when(F.col("prev_seq").isNull(), F.col("seq") > 1).otherwise(F.col("seq") - F.col("prev_seq") > 1)
    real_gap = gap & (chance(gap_rows) < ACCIDENT)
    first = F.col("prev_seq").isNull()
    known = F.col("life").isin(*ALIASES)
    mean = F.when(F.col("n_whole") + F.col("n_decimal") + F.col("n_flag") + F.col("n_text") > 0, F.col("n_chars") / (F.col("n_whole") + F.col("n_decimal") + F.col("n_flag") + F.col("n_text")))

    def event(on: Column, file: Column, change: str, name: Column) -> Column:
        return F.when(on & file.isNotNull(), F.struct(file.alias("import_id"), F.lit(change).alias("change"), name.alias("field_name"), F.col("kind"), mean.alias("mean"), known.alias("known")))

    tail_rows = F.col("total") - F.col("upto")
    events = F.array(
        event(real_gap, F.col("import_id"), "added", F.col("field")),
        event(real_gap & ~first, F.col("prev_next"), "removed", F.col("prev_name")),
        event(~first & ~real_gap & (F.col("field") != F.col("prev_name")), F.col("import_id"), "renamed", F.col("field")),
        event(~first & ~real_gap & (F.col("kind") != F.col("prev_kind")) & (F.col("grp") != "published_at"), F.col("import_id"), "retyped", F.col("field")),
        event(F.col("is_last") & (F.col("seq") < F.col("last_seq")) & (chance(tail_rows) < ACCIDENT), F.col("next_import"), "removed", F.col("field")),
    )
    log = written(cat.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*"))
    # unknown names: an ending and a start of like content in one file
    pair = W.partitionBy("import_id", "kind").orderBy("field_name")
    loose = log.where(F.col("change").isin("added", "removed"))
    added = loose.where("change = 'added'").withColumn("k", F.row_number().over(pair))
    removed = loose.where("change = 'removed'").withColumn("k", F.row_number().over(pair))
    same = added.alias("a").join(removed.alias("r"), ["import_id", "kind", "k"]).where(
        ~(F.col("a.known") & F.col("r.known")) & (F.col("a.mean") / F.col("r.mean")).between(0.8, 1.25)
    )
    renamed = same.select("import_id", F.col("a.field_name").alias("to"), F.col("r.field_name").alias("from"))
    gone = renamed.select("import_id", F.explode(F.array(F.struct(F.lit("added").alias("change"), F.col("to").alias("field_name")), F.struct(F.lit("removed").alias("change"), F.col("from").alias("field_name")))).alias("e")).select("import_id", "e.*")
    kept = log.select("import_id", "change", "field_name").join(gone, ["import_id", "change", "field_name"], "left_anti")
    return kept.unionByName(renamed.select("import_id", F.lit("renamed").alias("change"), F.col("to").alias("field_name"))).distinct()


#: Fields that have a typed column, with its type; the cell as delivered stands beside it.
CASTS = {"words": "double", "reach": "double", "shares": "double", "score": "double", "page": "double", "paywall": "boolean"}
_RECORD = "row_id long, import_id long, names array<string>, vals array<string>, unread string"


def _record_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names and cells of each record; one that can't be read comes out whole in ``unread``."""
    for pdf in batches:
        known = pdf["__header"].notna().to_numpy()
        heads = {h: read_header(None if pd.isna(h) else h) for h in pdf["__header"].unique()}
        lines = [None if pd.isna(x) else x for x in pdf["raw_line"]]
        index = StructuralIndex([clean_record(x) for x in lines], np.fromiter((ord(heads[h][0]) for h in pdf["__header"]), np.uint8, len(lines)))
        names, vals, unread = [], [], []
        for i, h in enumerate(pdf["__header"]):
            cells = index.cells(i) if known[i] else None
            read = cells is not None and len(cells) == len(heads[h][1])
            names.append(heads[h][1] if read else None)
            vals.append(cells if read else None)
            unread.append(None if read else lines[i])
        yield pd.DataFrame({"row_id": pdf["line_id"], "import_id": pdf["import_id"], "names": names, "vals": vals, "unread": unread})


def _unified(records: DataFrame, payload: str) -> DataFrame:
    """Records of ``names`` and ``vals`` under the columns of the one table.

    Of several names of one field, the first filled one in the order of the alias table fills the column; whatever
    no column holds stands under its own name in ``others``.
    """
    cell = F.transform(F.arrays_zip("names", "vals"), lambda c: F.struct(c["names"].alias("name"), F.trim(c["vals"]).alias("value")))
    filled = F.filter(F.coalesce(cell, F.array().cast("array<struct<name:string,value:string>>")), lambda c: c["value"] != "")
    tidy = records.select("row_id", "import_id", "unread", filled.alias("cells")).withColumn("keys", F.col("cells.name"))
    place = {f: F.coalesce(*[F.nullif(F.array_position("keys", F.lit(a)), F.lit(0)) for a in ALIASES[f]]).cast("int") for f in ALIASES}
    placed = tidy.select("row_id", "import_id", "unread", "cells", F.array(*place.values()).alias("places"))
    picked = {f: F.get(F.col("cells.value"), F.get("places", F.lit(k)) - 1) for k, f in enumerate(ALIASES)}
    left = F.filter("cells", lambda c, i: ~F.coalesce(F.array_contains(F.filter("places", lambda p: p.isNotNull()), i + 1), F.lit(False)))
    row = placed.select("row_id", "import_id", "unread", *[v.alias(f) for f, v in picked.items()], left.alias("left"))
    failed = [F.when(F.col(f).try_cast(t).isNull() & ~F.lower(f).isin(*NOTHING), F.lit(f)) for f, t in CASTS.items()]
    names = F.array_distinct(F.col("left.name"))
    return row.select(
        F.lit(payload).alias("payload"), "row_id", "import_id",
        *[(F.col(f).try_cast(CASTS[f]) if f in CASTS else F.col(f)).alias(f) for f in ALIASES],
        *[F.col(f).alias(f"{f}_raw") for f in CASTS],
        F.filter(F.array(*failed), lambda f: f.isNotNull()).alias("uncast"),
        F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter("left", lambda c: c["name"] == n), lambda c: c["value"]))).alias("others"),
        "unread",
    )


def unified_objects(rows: DataFrame) -> DataFrame:
    """The objects of ``rows`` (row_id, import_id, raw) in one table, as in ``unified_rows``."""
    parsed = rows.select("row_id", "import_id", "raw", F.from_json("raw", "map<string,string>").alias("o"))
    name = lambda k: F.lower(F.regexp_replace(k, r"^[\s\ufeff]+|[\s\ufeff]+$", ""))
    records = parsed.select(
        "row_id", "import_id", F.transform(F.map_keys("o"), name).alias("names"), F.map_values("o").alias("vals"), F.when(F.col("o").isNull(), F.col("raw")).alias("unread")
    )
    return _unified(records, "import_rows")


def unified_records(lines: DataFrame) -> DataFrame:
    """The records of ``lines`` (line_id, import_id, line_no, raw_line) in one table, as in ``unified_rows``; headers are no records."""
    records = with_headers(lines.select("line_id", "import_id", "line_no", "raw_line")).select("line_id", "import_id", "raw_line", "__header").mapInPandas(_record_cells, _RECORD)
    return _unified(records, "syndication_lines")


def unified_rows(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Every record of ``lines`` and every object of ``rows`` in one table: one row each, repeated ones too.

    ``payload`` names the table and ``row_id`` the row (``line_id`` of a line). Names of one field are drawn
    together. A field with a type has its cast, null where a cell doesn't fit, the cell as delivered under
    ``<field>_raw``, and its name in ``uncast`` where a cell that stands for something didn't fit. ``others`` holds
    the cells that have no column, by name; ``unread`` the record or object that can't be read at all. Blank cells
    are null.
    """
    return unified_records(lines).unionByName(unified_objects(rows))
