from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from covertrace.operators import delimited, instants, schema_drift

LINES = "line_id long, import_id long, line_no long, raw_line string, extra string"


def lines(spark, *records, header="Headline,Date,URL,Source"):
    data = [(0, 1, 1, header, "x")] + [(i, 1, i + 1, r, "x") for i, r in enumerate(records, 1)]
    return spark.createDataFrame(data, LINES)


def test_reject_reasons_in_their_order(spark):
    found = dict(rows(delimited.rejected_records(lines(
        spark, "A,2019-03-04,u,S", '"A,2019-03-04,u,S', '"A "x" b",2019-03-04,u,S', "A,2019-03-04,u", "   ,2019-03-04,u,S", "A,2019-02-30,u,S", "A,,u,S", "A,4 March 2019,, ", "A,04/03/2019 10:11,,S",
        '"A, ""b""\nc",2019-03-04T10:11:12,u,', 'A 5" b,2019-03-04,u,S', None, "A,2019-03-04,u,S",
    ))))
    assert found == {2: "quoting", 3: "quoting", 4: "column_count", 5: "headline", 6: "publication_date", 7: "publication_date", 8: "outlet", 12: "column_count"}


def test_other_delimiters_marks_and_missing_headers(spark):
    assert rows(delimited.loaded_records(lines(spark, "S|A|2019-03-04|", header='﻿"Medie"|Rubrik |DATO|Link')), "headline", "outlet_name") == [("A", "S")]
    orphan = spark.createDataFrame([(5, 9, 2, "a,b", None)], LINES)
    assert rows(delimited.rejected_records(orphan)) == [(5, "column_count")]
    assert delimited.rejected_records(orphan.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('a",\n', max_size=12), min_size=1, max_size=8))
def test_index_equals_the_scan(records):
    index = delimited.StructuralIndex(records, np.full(len(records), ord(","), np.uint8))
    for i, r in enumerate(records):
        assert index.bounds(i) == delimited.scan_cells(r.encode(), ord(","))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('ab", \né', max_size=8), min_size=1, max_size=5))
def test_written_cells_come_back(cells):
    record = ",".join('"' + c.replace('"', '""') + '"' for c in cells)
    assert delimited.StructuralIndex([record], np.array([44], np.uint8)).cells(0) == cells


def test_drift_of_delimited_files(spark):
    imports = spark.createDataFrame([(k, "f", datetime(2020, 1, k), "syndication_lines") for k in (1, 2, 3, 4)], "id long, feed string, imported_at timestamp, payload string")
    data = [
        (1, 1, 1, "Headline,Date,Source,Words"), (2, 1, 2, "A,2019-01-01,S,12"), (3, 2, 1, '" HEADLINE",date,Source,Words'), (4, 2, 2, "A,2019-01-01,S,12.5"), (5, 2, 3, '"broken,2019-01-01,S,x'),
        (6, 3, 1, "Headline,Date,Outlet,Page"), (7, 3, 2, "A,2019-01-01,S,7"), (8, 4, 1, "Page,Outlet,Date,Headline"), (9, 4, 2, ",S,3 March 2019,A"),
    ]
    log = schema_drift.drift_log(imports, spark.createDataFrame(data, "line_id long, import_id long, line_no long, raw_line string"), None)
    assert rows(log) == [(2, "retyped", "words"), (3, "added", "page"), (3, "removed", "words"), (3, "renamed", "outlet")]


def test_drift_of_objects_forgives_unfilled_fields(spark):
    imports = spark.createDataFrame([(k, "f", datetime(2020, 1, k)) for k in (1, 2, 3)], "id long, feed string, imported_at timestamp")
    rare = [(1, '{"Headline": "a", "Body": "b"}')] + [(1, '{"Headline": "a"}')] * 5 + [(2, '{"Headline": "a"}')] * 6 + [(3, '{"Headline": "a", "Body": "b"}')] + [(3, '{"Headline": "a", "Score": 1}')] * 5 + [(3, None), (3, "no json")]
    log = schema_drift.drift_log(imports, None, spark.createDataFrame(rare, "import_id long, raw string"))
    assert rows(log) == [(3, "added", "score")]
    assert schema_drift.drift_log(imports, None, spark.createDataFrame([], "import_id long, raw string")).count() == 0


def test_unknown_names_of_like_content_are_renamed(spark):
    imports = spark.createDataFrame([(k, "f", datetime(2020, 1, k)) for k in (1, 2)], "id long, feed string, imported_at timestamp")
    data = [(1, '{"foo": "abcd", "Score": "1"}')] * 9 + [(2, '{"bar": "abce"}')] * 9
    log = schema_drift.drift_log(imports, None, spark.createDataFrame(data, "import_id long, raw string"))
    assert rows(log) == [(2, "removed", "score"), (2, "renamed", "bar")]


def test_unified_table(spark):
    data = [(1, 1, '{"Title ": " A ", "Words": "12.5", "Locked": true, "zzz": 1}'), (2, 1, None), (3, 1, '{"HEADLINE": "", "Reach": "many"}')]
    out = {r.row_id: r for r in schema_drift.unified_objects(spark.createDataFrame(data, "row_id long, import_id long, raw string")).collect()}
    assert out[1].headline == "A" and out[1].words == 12.5 and out[1].paywall is True and out[2].headline is None and out[3].headline is None and out[3].reach is None


def test_unified_table_holds_lines_and_unknown_fields(spark):
    data = [(1, 1, 1, "Title;Date;Source;Words;Mood;Mood;Heading"), (2, 1, 2, "A;2019-01-01;S;12;glad;calm;B"), (3, 1, 3, ";;S;;;;B"), (4, 1, 4, '"broken;x'), (5, 9, 2, "no header"), (6, 1, 6, None)]
    objects = spark.createDataFrame([(1, 7, '{"Headline": "", "TITLE": "C", "zzz": 1}'), (2, 7, "no json"), (3, 7, None)], "row_id long, import_id long, raw string")
    table = schema_drift.unified_rows(spark.createDataFrame(data, "line_id long, import_id long, line_no long, raw_line string"), objects).collect()
    out = {(r.payload[0], r.row_id): r for r in table}
    assert sorted(out) == [("i", 1), ("i", 2), ("i", 3), ("s", 2), ("s", 3), ("s", 4), ("s", 5), ("s", 6)] and len(table) == 8
    assert (out["s", 2].headline, out["s", 2].words, out["s", 2].others) == ("A", 12.0, {"mood": ["glad", "calm"], "heading": ["B"]})
    assert out["s", 3].headline == "B" and out["s", 3].others == {} and out["s", 4].unread == '"broken;x' and out["s", 5].unread == "no header"
    assert out["i", 1].headline == "C" and out["i", 1].others == {"zzz": ["1"]} and out["i", 2].unread == "no json" and out["i", 3].unread is None


def test_unified_table_keeps_cells_that_do_not_cast(spark):
    data = [(1, 1, '{"Words": "44 pts", "Locked": "partly", "Score": "n/a", "Page": "3"}')]
    (r,) = schema_drift.unified_objects(spark.createDataFrame(data, "row_id long, import_id long, raw string")).collect()
    assert r.words is None and r.words_raw == "44 pts" and r.paywall_raw == "partly" and r.page == 3 and r.page_raw == "3"
    assert r.uncast == ["words", "paywall"] and r.score_raw == "n/a"


CASES = [
    ("2021-04-24T22:06:31Z", "2021-04-24T22:06:31"), ("2018-06-19T11:08:57.5+02:00", "2018-06-19T09:08:57.5"), ("20231026T171052Z", "2023-10-26T17:10:52"), ("1541179930", "2018-11-02T17:32:10"),
    ("1560515191987", "2019-06-14T12:26:31.987"), ("03/09/2020 00:36", "2020-09-02T22:36:00"), ("02/20/2019 02:39", "2019-02-20T01:39:00"), ("Mon, 27 Jan 2020 20:17:16 +0100", "2020-01-27T19:17:16"),
    ("Wed, 11 Jul 2018 17:38 GMT", "2018-07-11T17:38:00"), ("2023-12-03T18:57[Asia/Tokyo]", "2023-12-03T09:57:00"), ("6. august 2022 kl. 03:55", "2022-08-06T01:55:00"), ("April 10, 2021 1:53 PM", "2021-04-10T11:53:00"),
    ("12:30 2021", None), ("2022-02-21", None), ("2023", None), ("last Tuesday", None), ("2023-03-26T02:26:00", None), ("29/10/2023 02:05", None), ("2022-13-01 08:00", None), (None, None), ("", None),
    (" 27 février 2023 00:04 ", "2023-02-26T23:04:00"), ("2022-04-09 03:49 CEST", "2022-04-09T01:49:00"), ("2019-10-27T02:14[Europe/Oslo]", None), ("2020-01-01 10:00 XYZ", None),
]


def test_instants(spark):
    data = [(i, 1, 1, t) for i, (t, _) in enumerate(CASES)]
    r = spark.createDataFrame(data, "row_id long, import_id long, campaign_id long, published_at string")
    campaigns = spark.createDataFrame([(1, "Europe/Copenhagen")], "id long, timezone string")
    imports = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id long, imported_at timestamp")
    found = dict(rows(instants.normalised_instants(r, campaigns, imports)))
    for i, (text, expected) in enumerate(CASES):
        us = None if expected is None else round(datetime.fromisoformat(expected).replace(tzinfo=timezone.utc).timestamp() * 1e6)
        assert found.get(i) == us, text


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_instants_do_not_depend_on_the_session(spark, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        r = spark.createDataFrame([(1, 1, 1, "2020-07-01 12:00:00")], "row_id long, import_id long, campaign_id long, published_at string")
        campaigns = spark.createDataFrame([(1, "Asia/Tokyo")], "id long, timezone string")
        imports = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id long, imported_at timestamp")
        assert rows(instants.normalised_instants(r, campaigns, imports)) == [(1, 1593572400000000)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_missing_zone_is_estimated(spark):
    # published 10:00 on the wall, delivered at 01:30 UTC: only Tokyo has it published by then
    r = spark.createDataFrame([(1, 1, 2, "2020-07-01 10:00:00"), (2, 2, 1, "2020-07-01 10:00:00")], "row_id long, import_id long, campaign_id long, published_at string")
    campaigns = spark.createDataFrame([(1, "Europe/Copenhagen"), (2, None), (3, "Asia/Tokyo")], "id long, timezone string")
    imports = spark.createDataFrame([(1, datetime(2020, 7, 1, 1, 30)), (2, datetime(2021, 1, 1))], "id long, imported_at timestamp")
    found = dict(rows(instants.normalised_instants(r, campaigns, imports)))
    assert found == {1: 1593565200000000, 2: 1593590400000000}
