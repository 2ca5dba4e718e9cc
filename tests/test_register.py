import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from covertrace import schemas
from covertrace.operators import doctor, mentions, register
from covertrace.sources import sheets
from covertrace.streaming import alerts, schedule


def test_every_table_has_a_schema(spark):
    assert len(schemas.COLUMNS) == 16 and all(len(schemas.schema(t).fields) > 3 for t in schemas.COLUMNS)


def test_validation(spark):
    data = [(1, "A", "a", "o", "journalism", "live", "2019", None, "UTC", "[]", None), (2, "B", "b", "o", "journalism", "live", None, None, "UTC", "[]", "day"), (3, "C", "a", "o", "coalition", "pre_publication", None, None, "UTC", None, "day"),
            (4, "D", "d", "o", "party", "live", "2019", None, "UTC", "[]", "day"), (5, "E", "e", "o", "coalition", "archived", "2019", None, "UTC", "{", "day"), (6, None, None, "o", "coalition", "live", "2019", None, None, None, "week")]
    ok, bad = schemas.validate(spark.createDataFrame(data, schemas.schema("campaigns")), "campaigns")
    assert rows(ok, "id") == [(1,)]
    assert dict(rows(bad, "id", "reason")) == {2: "published_at", 3: "unique", 4: "campaign_type", 5: "themes", 6: "name"}
    outlets = spark.createDataFrame([(1, "A", None, None, None, "blog", 5, None, 0, None, 0), (2, "B", None, None, None, "blog", 5, "s", 1, None, 0), (3, "C", None, None, None, "blog", None, None, None, None, None)], schemas.schema("outlets"))
    ok, bad = schemas.validate(outlets, "outlets")
    assert rows(ok, "id") == [(3,)] and dict(rows(bad, "id", "reason")) == {1: "reach_source", 2: "reach_method"}
    assert rows(register.with_reach(outlets, 3, 9, "s").where("id = 3"), "reach_value", "reach_source") == [(9, "s")]
    with pytest.raises(ValueError):
        register.with_reach(outlets, 3, 9, "")


def test_campaigns_and_day_indexes(spark):
    c = register.added_campaign(spark.createDataFrame([], schemas.schema("campaigns")), "Soy & Meal", campaign_type="coalition", published_at="2019-03-04")
    assert rows(c, "id", "slug", "status") == [(1, "soy-meal", "live")]
    a = spark.createDataFrame([(1, 1, "2019-03-06", 99), (2, 7, "2019-03-06", 5), (3, 1, "soon", 1)], "id long, campaign_id long, published_at string, day_index int")
    assert rows(register.reindexed(a, c), "id", "day_index") == [(1, 2), (2, None), (3, None)]
    assert rows(register.reindexed(a, register.updated(c, 1, published_at="2019-03-08")).where("id = 1"), "day_index") == [(-2,)]


def test_decisions_by_hand(spark):
    members = spark.createDataFrame([(1, 10, "hash", 1.0, None), (1, 11, "hash", 1.0, 10)], schemas.schema("cluster_members"))
    merged = register.merged_by_hand(members, [10, 12], 5)
    assert rows(merged, "cluster_id", "article_id") == [(1, 10), (1, 11), (5, 10), (5, 12)] and rows(register.kept_on_reset(merged), "article_id") == [(10,), (12,)]
    assert rows(register.split_out(merged, 10), "article_id") == [(11,), (12,)]
    with pytest.raises(ValueError):
        register.merged_by_hand(members, [10], 5)
    clusters = spark.createDataFrame([(1, 1, 10, "hash", 9), (6, 1, 99, "hash", 9)], schemas.schema("clusters"))
    assert rows(register.member_counts(clusters, members), "id", "member_count") == [(1, 2), (6, 0)]
    articles = spark.createDataFrame([(10, 1, "H", "2019")], "id long, campaign_id long, headline string, published_at string")
    assert rows(register.cluster_view(clusters, articles), "id", "headline") == [(1, "H"), (6, None)]
    m = spark.createDataFrame([(1, 10, "rule"), (2, 10, "human"), (3, 77, "rule")], "id long, article_id long, classified_by string")
    assert rows(register.without_machine_mentions(m, articles, 1), "id") == [(2,), (3,)]


def test_setup_findings(spark):
    e = spark.createDataFrame([(1, "Own", "own_company", "[]")], schemas.schema("entities"))
    r = spark.createDataFrame([(1, None, "n", "keyword", "TODO", None, True, False, None, "failed")], schemas.schema("watch_rules"))
    runs = spark.createDataFrame([(1, datetime(2019, 1, 1), datetime(2019, 1, 1), 1, 0, 0, "x")], schemas.schema("watch_runs"))
    log, signals = spark.createDataFrame([], schemas.schema("escalations")), spark.createDataFrame([(1, 1, "1970-01-01", "other", "s", None, "x")], schemas.schema("inbound_signals"))
    found = {x.code for x in doctor.setup_findings(e, r, runs, log, signals, F.lit(datetime(2019, 2, 1))).collect()}
    assert found == {"own-company-no-aliases", "no-competitors", "placeholder-watch-patterns", "watch-rules-failing", "no-automated-ingest", "poller-stale", "no-escalations", "placeholder-signals"}
    empty = {x.code for x in doctor.setup_findings(e.limit(0), r.limit(0), runs.limit(0), log, signals.limit(0), F.lit(datetime(2019, 2, 1))).collect()}
    assert {"no-own-company", "no-watch-rules", "poller-never-run"} <= empty


def test_schedule_moves_marks_only_on_success(spark):
    rules = spark.createDataFrame([(1, 5, datetime(2019, 3, 1), None), (2, 6, None, None), (3, 7, datetime(2019, 3, 1), "old")], "rule_id long, campaign_id long, last_polled_at timestamp, last_error string")
    now = datetime(2019, 3, 2)

    def fetch(rule, start, end):
        if rule["rule_id"] == 2:
            raise RuntimeError("down")
        return spark.range(300 if rule["rule_id"] == 3 else 2)

    outcomes, after = schedule.run(rules, now, fetch, lambda _, df: df.count() // 2)
    assert [(o.rule_id, o.rows, o.inserted, o.capped, o.error) for o in outcomes] == [(1, 2, 1, False, None), (2, 0, 0, False, "RuntimeError: down"), (3, 300, 150, True, None)]
    assert outcomes[0].start == datetime(2019, 2, 28) and outcomes[1].start == datetime(2019, 2, 23)
    assert rows(after, "rule_id", "last_polled_at", "last_error") == [(1, now, None), (2, None, "RuntimeError: down"), (3, now, None)]
    assert rows(schedule.campaigns_to_recluster(outcomes, rules)) == [(5,), (7,)]
    dry, same = schedule.run(rules, now, fetch, lambda *_: 1 / 0, dry_run=True)
    assert dry[0].inserted == 0 and rows(same) == rows(rules)


def test_alerts_contain_failures(spark, tmp_path):
    hits = spark.createDataFrame([(1, "u", "t")], "rule_id long, url string, title string")
    sent = []
    tell = alerts.alerting({"file": alerts.file_channel(str(tmp_path / "a.jsonl")), "broken": lambda _: 1 / 0, "post": alerts.posting_channel(lambda u, b: sent.append((u, b)), "https://x.test")})
    errors = tell(hits)
    assert errors["file"] is None and "ZeroDivisionError" in errors["broken"] and len(sent) == 1 and (tmp_path / "a.jsonl").read_text().count("\n") == 1
    assert alerts.readiness({"mail": ("HOST", "TO")}, {"HOST": "h"}) == {"mail": ["TO"]}


def test_reviewed_roles(spark):
    m = spark.createDataFrame([(1, "passing_reference", 0.3, "a"), (2, "subject", 0.8, "b"), (3, "passing_reference", 0.3, "c")], "id long, role string, confidence double, evidence_sentence string").coalesce(1)
    out = mentions.reviewed_roles(m, lambda s: [("subject", 1.7) if x == "a" else ("villain", 1.0) for x in s])
    assert rows(out, "id", "role", "confidence") == [(1, "subject", 1.0), (2, "subject", 0.8), (3, "passing_reference", 0.3)]
    assert mentions.reviewed_roles(m, None) is m
    assert rows(mentions.reviewed_roles(m, lambda s: 1 / 0)) == rows(m)


def test_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Overskrift</t></si><si><r><t>A </t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Dato</t></is></c><c r="D1" t="inlineStr"><is><t>Medie</t></is></c></row>'
                   '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2019-03-04</v></c></row><row><c r="A3"/></row></sheetData></worksheet>')  # fmt: skip
    (tmp_path / "a.xlsx").write_bytes(buffer.getvalue())
    df = sheets.read_sheets(spark, str(tmp_path), defaults={"country": "DK", "outlet_tier": "blog"})
    assert rows(df, "headline", "published_at", "outlet_name", "country", "outlet_tier") == [("A b", "2019-03-04", None, "DK", "blog")]
