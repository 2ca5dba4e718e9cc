import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows
from covertrace.functions.text import STOPWORDS, comparison_form
from covertrace.operators import clusters, components, intake, mentions
from covertrace.streaming import watch

CANONICAL = "row_id long, import_id long, " + ", ".join(f"{f} string" for f in intake.FIELDS)


def delivered(spark, *data):
    full = [(k, 1, *[d.get(f) for f in intake.FIELDS]) for k, d in enumerate(data, 1)]
    return spark.createDataFrame(full, CANONICAL)


def test_rejects_in_their_order(spark):
    checked = intake.normalised(delivered(
        spark, {}, {"headline": " "}, {"headline": "A"}, {"headline": "A", "published_at": "soon"}, {"headline": "A", "published_at": "2019-03-04"},
        {"headline": "A", "published_at": "2019-03-04", "url": "https://www.x.test/1"},
    ))
    assert [r.reject_reason for r in checked.orderBy("row_id").collect()] == [
        "no headline", "no headline", "no publication date", "unparseable publication date", "no outlet name, outlet domain or URL to derive an outlet from", None]
    ok = checked.where("reject_reason is null").first()
    assert (ok.outlet_name, ok.outlet_domain, ok.outlet_tier) == ("x.test", "x.test", "blog")
    assert {r.outcome: r.n for r in intake.outcome_counts(checked).collect()}["accepted"] == 1
    assert intake.rejection_samples(checked).count() == 5


def test_outlets_are_found_by_domain_then_by_name(spark):
    checked = intake.normalised(delivered(spark, *[{"headline": "A", "published_at": "2019-03-04", **d} for d in ({"url": "https://www.x.test/1"}, {"outlet_name": "Known Paper"}, {"outlet_domain": "new.test"}, {"outlet_domain": "www.new.test"})]))
    outlets = spark.createDataFrame([(1, "X", "x.test"), (2, "Known Paper", None)], "id long, name string, domain string")
    assert rows(intake.outlet_matches(checked, outlets)) == [("known paper", 2, 2, 1), ("new.test", None, 3, 2), ("x.test", 1, 1, 1)]


def test_natural_keys(spark):
    schema = "id long, import_id long, campaign_id long, outlet_id long, url string, body_hash string, published_at string"
    accepted = spark.createDataFrame([(1, 1, 1, 1, "u1", None, "d"), (2, 1, 1, 1, None, None, "d")], schema)
    batch = spark.createDataFrame([(11, 2, 1, 1, "u1", None, "d"), (12, 2, 1, 1, "u2", None, "d"), (13, 2, 1, 1, "u2", "h", "e"), (14, 2, 1, 1, None, None, "d"), (15, 2, 1, 1, None, "h", "d"), (16, 2, 2, 1, "u1", None, "d")], schema)
    new = intake.new_articles(batch, accepted)
    assert rows(new, "id") == [(12,), (15,), (16,)]
    assert rows(intake.ledger_counts(batch, new)) == [(2, 6, 3, 3)]
    assert intake.new_articles(batch, accepted.unionByName(new)).count() == 0


def test_fingerprint_and_windows(spark):
    df = spark.createDataFrame([("x", "", 3)], "b string, a string, c int")
    assert df.select(intake.row_fingerprint(df, df.columns) == F.sha2(F.lit("b=x|c=3"), 256)).first()[0]
    rules = spark.createDataFrame([("a", None), ("b", datetime(2019, 3, 9)), ("c", datetime(2018, 1, 1))], "rule_id string, last_polled_at timestamp")
    found = {r[0]: r[1] for r in intake.fetch_windows(rules, F.lit(datetime(2019, 3, 10))).collect()}
    assert found == {"a": datetime(2019, 3, 3), "b": datetime(2019, 3, 8), "c": datetime(2019, 3, 3)}


def test_hash_clusters(spark):
    a = spark.createDataFrame([(1, 1, "h", "2019-02"), (2, 1, "h", "2019-01"), (3, 2, "h", "2019-01"), (4, 1, None, "x"), (5, 1, None, "x")], "id long, campaign_id long, body_hash string, published_at string")
    assert rows(clusters.hash_clusters(a)) == [(1, 1, 2, 2), (2, 1, 2, 2)]


def brute_leaders(data):
    """The ordered scan over all pairs."""
    leaders, out = [], {}
    for i, c, at, headline, body in sorted(data, key=lambda r: (r[1], r[2].isoformat(), r[0])):
        title = frozenset(w for w in comparison_form(headline).split() if w not in STOPWORDS)
        shingles = clusters._shingles(comparison_form(body))
        out[i] = i
        for leader, lc, lat, lt, ls in leaders:
            if lc == c and abs((lat - at).days) <= 3:
                j = lambda x, y: len(x & y) / len(x | y) if x and y else 0
                if j(title, lt) >= 0.9 or j(shingles, ls) >= 0.7:
                    out[i] = leader
                    break
        if out[i] == i:
            leaders.append((i, c, at, title, shingles))
    return out


def test_leaders_equal_the_pairwise_scan(spark):
    rng = random.Random(3)
    words = "harbour crew fish quota port buyer meal union court".split()
    data = []
    for i in range(400):
        at = datetime(2019, 3, 1) + timedelta(hours=rng.randrange(24 * 40))
        data.append((i, rng.randrange(3), at, " ".join(rng.sample(words, rng.choice((2, 3)))), " ".join(rng.choices(words[:4], k=rng.choice((0, 6, 9))))))
    df = spark.createDataFrame([(i, c, at.isoformat(), h, b, None) for i, c, at, h, b in data], "id long, campaign_id long, published_at string, headline string, body_text string, body_hash string")
    led = clusters.leader_clusters(df)
    assert {r.id: r.leader_id for r in led.collect()} == brute_leaders(data)
    assert clusters.cluster_report(led).count() > 0
    assert clusters.leader_clusters(df.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(None, 3), (400, 401), (401, 402), (402, 403)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    found = {r.id: r.root for r in components.smallest_linked(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in list(parent)}
    assert components.smallest_linked(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mentions(spark):
    body = "The port, sources say, supplies Nordic Aqua Feed A/S. Aquafórening denied it! An unrelated feeder came; Nordic Aqua-Feed too."
    a = spark.createDataFrame([(1, 1, "Nordic Aqua Feed named", body), (2, 1, "Nordic  Aqua Feed", None), (3, 1, None, None)], "id long, campaign_id long, headline string, body_text string")
    e = spark.createDataFrame([(7, ["Nordic Aqua Feed", "Nordic Aqua Feed A/S", "NA"]), (8, ["Aquaforening"]), (9, None)], "id long, forms array<string>")
    found = mentions.mentions(a, e)
    got = sorted((r.article_id, r.entity_id, r.role) for r in found.collect())
    assert got == [(1, 7, "named_supplier"), (1, 7, "passing_reference"), (1, 8, "quoted_response"), (2, 7, "passing_reference")]
    assert {r.ambiguous for r in mentions.match_report(found).where("role = 'passing_reference'").collect()} == {2}


RULES = "rule_id long, campaign_id long, rule_type string, pattern string, source_url string, enabled boolean, promotes_to_live boolean"


def rules(spark):
    return spark.createDataFrame([
        (1, 1, "rss", "f1", None, True, False), (2, 1, "keyword", "Fish quota", None, True, True), (3, 1, "phrase", "quota fish", None, True, False), (4, None, "domain", "x.test", None, True, False),
        (5, 1, "gdelt_query", "fish", None, True, True), (6, 1, "keyword", "!!", None, True, False), (7, 1, "byline", "åse", None, True, False), (8, 1, "keyword", "fish", None, False, True),
    ], RULES)


ITEM_ROWS = [
    {"feed": "f1", "title": "Quota for fish", "url": "https://a.x.test/1", "author": "Ase B", "summary": "", "published_at": "2019-03-05T00:00:00"},
    {"feed": "f1", "title": "Fishy", "url": "https://y.test/2", "author": None, "summary": "quota", "published_at": "2019-03-04T00:00:00"},
    {"feed": "f2", "title": "Quota fish", "url": "https://x.test/3", "author": None, "summary": None, "published_at": None},
]


def test_watch_rules_and_promotion(spark):
    items = spark.createDataFrame(ITEM_ROWS, watch.ITEMS)
    found = watch.hits(items, rules(spark))
    assert rows(found, "rule_id", "url") == [(1, "https://a.x.test/1"), (1, "https://y.test/2"), (2, "https://a.x.test/1"), (4, "https://a.x.test/1"), (7, "https://a.x.test/1")]
    campaigns = spark.createDataFrame([(1, None), (2, "2019-01-01")], "id long, published_at string")
    assert rows(watch.promotions(found, rules(spark), campaigns)) == [(1, "2019-03-05T00:00:00", 2, "https://a.x.test/1")]
    assert watch.promotions(found, rules(spark), campaigns.where("id = 2")).count() == 0
    assert watch.new_hits(found, found).count() == 0


def test_polling_alerts_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    alerts = []
    for name, content in (("a.json", ITEM_ROWS[:1]), ("b.json", ITEM_ROWS)):
        (inbox / name).write_text("\n".join(json.dumps(r) for r in content))
        watch.poll(spark, str(inbox), rules(spark), str(tmp_path / "hits"), str(tmp_path / "state"), lambda df: alerts.append(df.count())).awaitTermination(120)
    assert alerts == [4, 1] and spark.read.parquet(str(tmp_path / "hits")).count() == 5
