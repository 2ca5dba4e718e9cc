"""Queries of intake, clusters, mentions, watching, exports and checks, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from covertrace.functions.text import domain_of
from covertrace.operators import clusters, comparison, coverage, doctor, exports, intake, mentions, velocity
from covertrace.plans import adapters
from covertrace.session import table
from covertrace.sources.markup import html_to_text
from covertrace.streaming import watch

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _host_sql(c: str) -> str:
    """DuckDB text of ``domain_of``."""
    rest = f"regexp_replace(trim({c}), '^.*?//', '')"
    return f"nullif(regexp_replace(lower(split_part(list_last(string_split(split_part(split_part({rest}, '/', 1), '?', 1), '@')), ':', 1)), '^www\\.', ''), '')"


@query(f"SELECT {_host_sql('url')} AS domain, count(*) AS articles, count(DISTINCT outlet_id) AS outlets FROM articles WHERE url IS NOT NULL GROUP BY 1")
def domain_rollup(spark, sf_dir):
    a = table(spark, sf_dir, "articles").where("url is not null")
    return a.groupBy(domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("articles"), F.countDistinct("outlet_id").alias("outlets"))


def _clean_sql(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '')"


_DATES = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%d/%m/%Y %H:%M', '%d/%m/%Y', '%d-%m-%Y', '%m/%d/%Y', '%d %B %Y', '%d %b %Y', '%B %d, %Y', '%b %d, %Y']"
_CHECKED = f"""c AS (SELECT row_id, import_id, {_clean_sql('headline')} AS headline, {_clean_sql('published_at')} AS published_at, {_clean_sql('outlet_name')} AS nm,
coalesce({_host_sql(_clean_sql('outlet_domain'))}, {_host_sql(_clean_sql('url'))}) AS dom FROM import_rows),
t AS (SELECT *, regexp_replace(regexp_replace(published_at, '[Zz]$', '+0000'), '([+-][0-9]{{2}}):([0-9]{{2}})$', '\\1\\2') AS t FROM c),
b AS (SELECT *, regexp_replace(t, '[+-][0-9]{{4}}$', '') AS bare, regexp_matches(t, '[+-][0-9]{{4}}$') AS has FROM t),
k AS (SELECT *, coalesce(try_strptime(t, {_DATES}), CASE WHEN NOT has THEN try_strptime(t, '%Y-%m-%dT%H:%M:%S') END, CASE WHEN has THEN try_strptime(bare, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S']) END,
CASE WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.,][0-9]+)?)?)?([+-][0-9]{{4}})?$') THEN try_cast(replace(replace(bare, ',', '.'), 'T', ' ') AS TIMESTAMP) END,
CASE WHEN regexp_matches(t, '^[0-9]{{8}}T[0-9]{{6}}([+-][0-9]{{4}})?$') THEN try_strptime(bare, '%Y%m%dT%H%M%S') END) AS wall FROM b)"""


@query(f"""WITH {_CHECKED} SELECT import_id, CASE WHEN headline IS NULL THEN 'no headline' WHEN published_at IS NULL THEN 'no publication date' WHEN wall IS NULL THEN 'unparseable publication date'
WHEN coalesce(nm, dom) IS NULL THEN 'no outlet name, outlet domain or URL to derive an outlet from' ELSE 'accepted' END AS outcome, count(*) AS n FROM k GROUP BY 1, 2""")
def import_normalise_rejects(spark, sf_dir):
    return intake.outcome_counts(intake.normalised(table(spark, sf_dir, "import_rows")))


@query(f"""WITH {_CHECKED}, r AS (SELECT k.*, {_clean_sql('i.url')} AS url, CASE WHEN k.headline IS NULL THEN 'no headline' WHEN k.published_at IS NULL THEN 'no publication date'
WHEN wall IS NULL THEN 'unparseable publication date' WHEN coalesce(nm, dom) IS NULL THEN 'no outlet name, outlet domain or URL to derive an outlet from' END AS reject_reason FROM k JOIN import_rows i USING (row_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY import_id ORDER BY row_id) AS place FROM r WHERE reject_reason IS NOT NULL)
SELECT import_id, row_id, reject_reason, headline, published_at, url, coalesce(nm, dom) AS outlet_name FROM n WHERE place <= 50""")
def rejection_samples(spark, sf_dir):
    return intake.rejection_samples(intake.normalised(table(spark, sf_dir, "import_rows")))


@query(f"""WITH {_CHECKED}, w AS (SELECT row_id, coalesce({_host_sql('dom')}, {_host_sql('coalesce(nm, dom)')}) AS key, lower(trim(coalesce(nm, dom))) AS name FROM k),
g AS (SELECT key, min(row_id) AS first_row_id, count(*) AS rows, arg_min(name, row_id) AS name FROM w WHERE key IS NOT NULL GROUP BY 1),
d AS (SELECT lower(domain) AS key, min(id) AS by_domain FROM outlets WHERE domain IS NOT NULL GROUP BY 1), n AS (SELECT lower(trim(name)) AS name, min(id) AS by_name FROM outlets GROUP BY 1)
SELECT key, coalesce(by_domain, by_name) AS outlet_id, first_row_id, rows FROM g LEFT JOIN d USING (key) LEFT JOIN n USING (name)""")
def outlet_get_or_create(spark, sf_dir):
    checked = intake.normalised(table(spark, sf_dir, "import_rows"))
    return intake.outlet_matches(checked, table(spark, sf_dir, "outlets"))


_KEY = "CASE WHEN url IS NOT NULL THEN ['u', url, NULL, NULL] ELSE ['b', outlet_id::VARCHAR, body_hash, published_at] END"


@query(f"""WITH n AS (SELECT *, {_KEY} AS k FROM incoming_articles), o AS (SELECT campaign_id, {_KEY} AS k FROM articles),
f AS (SELECT min(id) AS id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.campaign_id = n.campaign_id AND o.k IS NOT DISTINCT FROM n.k) GROUP BY campaign_id, k)
SELECT n.import_id, count(*) AS row_count, count(f.id) AS rows_inserted, count(*) - count(f.id) AS rows_skipped_duplicate FROM n LEFT JOIN f USING (id) GROUP BY 1""")
def article_upsert(spark, sf_dir):
    batch = table(spark, sf_dir, "incoming_articles")
    return intake.ledger_counts(batch, intake.new_articles(batch, table(spark, sf_dir, "articles")))


@query("""WITH r AS (SELECT feed, max(imported_at) AS polled FROM imports GROUP BY 1), t AS (SELECT max(imported_at) AS now FROM imports)
SELECT feed AS rule_id, greatest(polled - INTERVAL 24 HOUR, now - INTERVAL 7 DAY) AS window_start, now AS window_end FROM r, t""")
def ingest_windows(spark, sf_dir):
    imports = table(spark, sf_dir, "imports")
    rules = imports.groupBy(F.col("feed").alias("rule_id")).agg(F.max("imported_at").alias("last_polled_at"))
    now = imports.agg(F.max("imported_at").alias("now"))  # one row
    return intake.fetch_windows(rules.crossJoin(F.broadcast(now)), F.col("now"))


@query("""WITH g AS (SELECT campaign_id, body_hash, count(*) AS members, arg_min(id, (published_at, id)) AS leader_id FROM articles WHERE body_hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
SELECT a.id, a.campaign_id, g.leader_id, g.members FROM articles a JOIN g USING (campaign_id, body_hash)""")
def hash_clusters(spark, sf_dir):
    return clusters.hash_clusters(table(spark, sf_dir, "articles"))


@query()
def leader_clusters(spark, sf_dir):
    return clusters.leader_clusters(table(spark, sf_dir, "articles"))


@query("SELECT campaign_id, count(DISTINCT cluster_id) + count(*) FILTER (cluster_id IS NULL) AS unique_stories FROM articles JOIN outlets ON outlet_id = outlets.id GROUP BY 1")
def unique_stories(spark, sf_dir):
    rows = coverage.article_rows(table(spark, sf_dir, "articles"), table(spark, sf_dir, "outlets"))
    return coverage.footprint(rows).select("campaign_id", "unique_stories")


@query("SELECT a.id, a.campaign_id, a.headline, a.published_at, a.day_index, a.url, o.name AS outlet_name, i.source, i.imported_at FROM articles a JOIN outlets o ON a.outlet_id = o.id JOIN imports i ON a.import_id = i.id WHERE a.day_index = 0")
def evidence_articles(spark, sf_dir):
    a, o, i = (table(spark, sf_dir, t) for t in ("articles", "outlets", "imports"))
    return exports.article_table(a, o, i, a.where("day_index = 0").select("id"))


_RULES = "id long, campaign_id long, rule_type string, pattern string, source_url string, enabled boolean, promotes_to_live boolean"
# Watch rules of the queries.
RULES = ((1, None, "rss", "feed", None, True, False), (2, 7, "keyword", "press notice", None, True, False), (3, 7, "phrase", "face july hearing", "feed", True, False),
         (4, None, "domain", "tarrecotediario.example", None, True, True), (5, 7, "keyword", "", "feed", True, False), (6, 7, "gdelt_query", "cargo", "feed", True, False), (7, 7, "byline", "karin", "feed", True, False))


def _rules(spark):
    return spark.createDataFrame(RULES, _RULES).withColumnRenamed("id", "rule_id")


def _items(spark, sf_dir):
    a = table(spark, sf_dir, "articles")
    return a.select(F.lit("feed").alias("feed"), F.col("headline").alias("title"), "url", F.col("byline").alias("author"), F.lit(None).cast("string").alias("summary"), "published_at")


def _form_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH i AS (SELECT url, {_form_sql('headline')} AS hay, {_form_sql('byline')} AS who, {_host_sql('url')} AS host FROM articles WHERE url IS NOT NULL),
h AS (SELECT 1 AS rule_id, url FROM i UNION ALL
SELECT 3, url FROM i WHERE contains(hay, 'face july hearing') UNION ALL
SELECT 4, url FROM i WHERE host = 'tarrecotediario.example' OR ends_with(host, '.tarrecotediario.example') UNION ALL
SELECT 7, url FROM i WHERE contains(who, 'karin'))
SELECT rule_id::BIGINT AS rule_id, count(DISTINCT url) AS hits FROM h GROUP BY 1""")
def watch_hits(spark, sf_dir):
    return watch.hits(_items(spark, sf_dir), _rules(spark)).groupBy("rule_id").agg(F.count("*").alias("hits"))


@query(f"""WITH i AS (SELECT url, headline, coalesce(published_at, '') AS at_, {_form_sql('headline')} AS hay, {_form_sql('byline')} AS who, {_host_sql('url')} AS host FROM articles WHERE url IS NOT NULL),
h AS (SELECT 3::BIGINT AS rule_id, 7::BIGINT AS campaign_id, * FROM i WHERE contains(hay, 'face july hearing') UNION ALL
SELECT 4, NULL, * FROM i WHERE host = 'tarrecotediario.example' OR ends_with(host, '.tarrecotediario.example') UNION ALL SELECT 7, 7, * FROM i WHERE contains(who, 'karin')),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, url ORDER BY at_, coalesce(headline, '')) AS k FROM h)
SELECT rule_id, url, campaign_id, coalesce(headline, '') AS title, nullif(at_, '') AS occurred_at FROM r WHERE k = 1""")
def watch_new_hits(spark, sf_dir):
    found = watch.hits(_items(spark, sf_dir), _rules(spark))
    return watch.new_hits(found, found.where("rule_id = 1"))


@query(f"""WITH i AS (SELECT url, coalesce(published_at, '') AS at_, {_host_sql('url')} AS host FROM articles WHERE url IS NOT NULL),
h AS (SELECT url, min(at_) AS at_ FROM i WHERE host = 'tarrecotediario.example' OR ends_with(host, '.tarrecotediario.example') GROUP BY 1),
b AS (SELECT at_ AS published_at, 4::BIGINT AS rule_id, url FROM h WHERE at_ <> '' ORDER BY at_, url LIMIT 1)
SELECT c.id AS campaign_id, b.published_at, b.rule_id, b.url FROM campaigns c, b WHERE c.id = 19 AND c.published_at IS NULL""")
def watch_promotions(spark, sf_dir):
    rules = _rules(spark).withColumn("campaign_id", F.coalesce("campaign_id", F.lit(19)))
    found = watch.hits(_items(spark, sf_dir), _rules(spark)).drop("campaign_id").join(F.broadcast(rules.select("rule_id", "campaign_id")), "rule_id")
    return watch.promotions(found, rules, table(spark, sf_dir, "campaigns"))


@query()
def alias_mentions(spark, sf_dir):
    publishers = table(spark, sf_dir, "campaigns").select("id", F.array("publisher_org").alias("forms"))
    return mentions.mentions(table(spark, sf_dir, "articles"), publishers)


@query()
def mention_report(spark, sf_dir):
    return mentions.match_report(alias_mentions(spark, sf_dir))


@query()
def html_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", html_to_text("text").alias("plain"))


@query("""WITH p AS (SELECT count(*) AS n FROM campaigns WHERE published_at IS NOT NULL AND published_at_precision IN ('month', 'year')),
d AS (SELECT count(*) AS n FROM campaigns WHERE substr(published_at, 1, 10) IN ('1970-01-01', '2019-01-01', '2020-01-01')),
v AS (SELECT count(*) AS n FROM campaigns c WHERE published_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.campaign_id = c.id)),
h AS (SELECT count(*) AS n FROM campaigns WHERE regexp_matches(lower(name) || ' ' || lower(coalesce(publisher_org, '')), 'todo|example\\.invalid|replace with|placeholder')),
u AS (SELECT count(*) AS n FROM articles WHERE day_index IS NULL),
r AS (SELECT count(*) AS a, count(reach_value) AS k FROM outlets)
SELECT * FROM (SELECT 'warning' AS level, 'imprecise-dates' AS code, n FROM p UNION ALL SELECT 'blocker', 'placeholder-dates', n FROM d UNION ALL SELECT 'blocker', 'no-coverage', n FROM v
UNION ALL SELECT 'blocker', 'placeholder-campaigns', n FROM h UNION ALL SELECT 'warning', 'undated-articles', n FROM u UNION ALL SELECT 'warning', 'no-reach', CASE WHEN k = 0 THEN a ELSE 0 END FROM r
UNION ALL SELECT 'warning', 'low-reach-coverage', CASE WHEN k > 0 AND 100.0 * k / a < 50 THEN a - k ELSE 0 END FROM r) WHERE n > 0""")
def doctor_findings(spark, sf_dir):
    imports = table(spark, sf_dir, "imports")
    return doctor.findings(*(table(spark, sf_dir, t) for t in ("campaigns", "outlets", "articles")), imports, F.max("imported_at"))


@query()
def snapshot_documents(spark, sf_dir):
    return exports.snapshot_documents(*(table(spark, sf_dir, t) for t in ("articles", "outlets", "campaigns")))


@query()
def comparison_table(spark, sf_dir):
    campaigns = table(spark, sf_dir, "campaigns")
    values = comparison.compare(table(spark, sf_dir, "articles"), table(spark, sf_dir, "outlets"), campaigns, [1, 3, 7], None, adapters.mentions(spark, sf_dir), adapters.escalations(spark, sf_dir))
    return comparison.pivoted(values, campaigns)


@query("""SELECT id, campaign_id, headline, published_at, day_index, url, outlet_name, source, imported_at FROM (SELECT a.*, o.name AS outlet_name, i.source, i.imported_at FROM articles a JOIN outlets o ON a.outlet_id = o.id
JOIN imports i ON a.import_id = i.id WHERE a.campaign_id = 7 ORDER BY a.day_index NULLS LAST, a.published_at, a.id LIMIT 60)""")
def briefing_evidence(spark, sf_dir):
    return exports.briefing_evidence(*(table(spark, sf_dir, t) for t in ("articles", "outlets", "imports")), 7)


@query(f"""WITH i AS (SELECT url, {_form_sql('headline')} AS hay, {_form_sql('byline')} AS who, {_host_sql('url')} AS host FROM articles WHERE url IS NOT NULL),
h AS (SELECT 1 AS rule_id, 19 AS campaign_id, url FROM i UNION SELECT 3, 7, url FROM i WHERE contains(hay, 'face july hearing')
UNION SELECT 4, 19, url FROM i WHERE host = 'tarrecotediario.example' OR ends_with(host, '.tarrecotediario.example') UNION SELECT 7, 7, url FROM i WHERE contains(who, 'karin')),
n AS (SELECT campaign_id, count(*) AS n FROM h GROUP BY 1)
SELECT id AS campaign_id, slug, coalesce(n, 0)::BIGINT AS hits FROM campaigns LEFT JOIN n ON id = campaign_id WHERE published_at IS NULL""")
def pre_publication(spark, sf_dir):
    rules = _rules(spark).select("rule_id", F.coalesce("campaign_id", F.lit(19)).alias("campaign_id"))
    found = watch.hits(_items(spark, sf_dir), _rules(spark)).drop("campaign_id").join(F.broadcast(rules), "rule_id")
    return comparison.pre_publication(table(spark, sf_dir, "campaigns"), found)


@query("""WITH d AS (SELECT c_mktsegment AS campaign_id, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS day_index, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT campaign_id, unnest(generate_series(min(day_index), max(day_index))) AS day_index FROM d GROUP BY 1)
SELECT campaign_id, day_index::INTEGER AS day_index, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN d USING (campaign_id, day_index)""")
def bench_lineitem_series(spark, sf_dir):
    return velocity.dense_series(velocity.daily_counts(adapters.line_rows(spark, sf_dir)))
