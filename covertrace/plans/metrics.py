"""Queries of the metrics, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertrace.operators import comparison, coverage, escalation, exposure, velocity
from covertrace.plans import adapters
from covertrace.session import table

QUERIES = {}
SQL: dict[str, str] = {}

ROWS = """rows_ AS (
  SELECT a.id, a.campaign_id, a.outlet_id, a.day_index, a.cluster_id, a.published_at, a.is_original, a.import_id, o.tier, o.reach_value,
         coalesce(nullif(a.country, ''), nullif(o.country, '')) AS place, coalesce(nullif(a.language, ''), nullif(o.language, '')) AS tongue, coalesce(a.cluster_id, -a.id) AS story
  FROM articles a JOIN outlets o ON a.outlet_id = o.id)"""
DAILY = "daily AS (SELECT campaign_id, day_index, count(*) AS n FROM rows_ WHERE day_index IS NOT NULL GROUP BY 1, 2)"
PEAK = "peak AS (SELECT campaign_id, arg_max(day_index, (n, -day_index)) AS peak_day, max(n) AS peak_volume FROM daily GROUP BY 1)"
DENSE = """span AS (SELECT campaign_id, min(day_index) AS lo, max(day_index) AS hi FROM daily GROUP BY 1),
days AS (SELECT campaign_id, unnest(generate_series(lo, hi))::INTEGER AS day_index FROM span),
dense AS (SELECT d.campaign_id, d.day_index, coalesce(x.n, 0)::BIGINT AS n FROM days d LEFT JOIN daily x USING (campaign_id, day_index))"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.article_rows(table(spark, sf_dir, "articles"), table(spark, sf_dir, "outlets"))


_FOOT = """count(*) AS total_articles, count(DISTINCT outlet_id) AS unique_outlets, count(DISTINCT story) AS unique_stories, count(DISTINCT place) AS country_count,
  count(DISTINCT tongue) AS language_count, count(DISTINCT CASE WHEN reach_value IS NOT NULL THEN outlet_id END) AS outlets_with_reach"""
_RATIOS = "round(unique_outlets::DOUBLE / unique_stories, 3) AS syndication_ratio, round(100.0::DOUBLE * outlets_with_reach / unique_outlets, 1) AS reach_coverage"


@query(f"""WITH {ROWS}, f AS (SELECT campaign_id, {_FOOT} FROM rows_ GROUP BY 1),
r AS (SELECT campaign_id, sum(reach)::BIGINT AS total_reach FROM (SELECT campaign_id, outlet_id, any_value(reach_value) AS reach FROM rows_ GROUP BY 1, 2) GROUP BY 1)
SELECT f.*, total_reach, {_RATIOS} FROM f JOIN r USING (campaign_id)""")
def campaign_footprint(spark, sf_dir):
    return coverage.footprint(rows(spark, sf_dir)).drop("cutoff")


@query(f"""WITH {ROWS}, c AS (SELECT unnest([7, 14, 30, 90])::INTEGER AS cutoff), x AS (SELECT * FROM rows_ JOIN c ON day_index <= cutoff),
f AS (SELECT campaign_id, cutoff, {_FOOT} FROM x GROUP BY 1, 2),
r AS (SELECT campaign_id, cutoff, sum(reach)::BIGINT AS total_reach FROM (SELECT campaign_id, cutoff, outlet_id, any_value(reach_value) AS reach FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT f.*, total_reach, {_RATIOS} FROM f JOIN r USING (campaign_id, cutoff)""")
def cutoff_matrix(spark, sf_dir):
    return coverage.footprint(rows(spark, sf_dir), coverage.CUTOFFS).where("total_articles > 0")


def _distribution_sql(key: str, name: str) -> str:
    return f"""WITH {ROWS}, t AS (SELECT campaign_id, count(*) AS total FROM rows_ GROUP BY 1)
SELECT campaign_id, {key} AS {name}, count(*) AS articles, round(count(*)::DOUBLE / any_value(total), 4) AS share FROM rows_ JOIN t USING (campaign_id) GROUP BY 1, 2"""


@query(_distribution_sql("tier", "tier"))
def tier_mix(spark, sf_dir):
    return coverage.distribution(rows(spark, sf_dir), "tier", "tier")


@query(_distribution_sql("place", "country"))
def country_distribution(spark, sf_dir):
    return coverage.distribution(rows(spark, sf_dir), "place", "country")


@query(_distribution_sql("tongue", "language"))
def language_distribution(spark, sf_dir):
    return coverage.distribution(rows(spark, sf_dir), "tongue", "language")


@query(f"""WITH {ROWS}, o AS (SELECT campaign_id, outlet_id, any_value(reach_value) AS reach FROM rows_ GROUP BY 1, 2)
SELECT campaign_id, sum(reach)::BIGINT AS total_reach, count(reach) AS outlets_with_reach, round(100.0::DOUBLE * count(reach) / count(*), 1) AS reach_coverage FROM o GROUP BY 1""")
def reach_and_coverage(spark, sf_dir):
    return coverage.footprint(rows(spark, sf_dir)).select("campaign_id", "total_reach", "outlets_with_reach", "reach_coverage")


@query(f"WITH {ROWS}, {DAILY} SELECT * FROM daily")
def daily_counts(spark, sf_dir):
    return velocity.daily_counts(rows(spark, sf_dir))


@query(f"WITH {ROWS}, {DAILY}, {DENSE} SELECT * FROM dense")
def dense_series(spark, sf_dir):
    return velocity.dense_series(velocity.daily_counts(rows(spark, sf_dir)))


_FIRST = """fo AS (SELECT campaign_id, day_index, count(*) AS k FROM (SELECT campaign_id, outlet_id, min(day_index) AS day_index FROM rows_ WHERE day_index IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2),
fc AS (SELECT campaign_id, day_index, count(*) AS k FROM (SELECT campaign_id, place, min(day_index) AS day_index FROM rows_ WHERE day_index IS NOT NULL AND place IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2),
run AS (SELECT d.campaign_id, d.day_index, d.n, sum(d.n) OVER w AS ca, sum(coalesce(fo.k, 0)) OVER w AS co, sum(coalesce(fc.k, 0)) OVER w AS cc
  FROM dense d LEFT JOIN fo USING (campaign_id, day_index) LEFT JOIN fc USING (campaign_id, day_index)
  WINDOW w AS (PARTITION BY d.campaign_id ORDER BY d.day_index ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {ROWS}, {DAILY}, {DENSE}, {_FIRST} SELECT campaign_id, day_index, n, ca::BIGINT AS cumulative_articles, co::BIGINT AS cumulative_outlets, cc::BIGINT AS cumulative_countries FROM run")
def cumulative_series(spark, sf_dir):
    return velocity.cumulative_series(rows(spark, sf_dir))


@query(f"""WITH {ROWS}, {DAILY}, {DENSE}, {_FIRST},
d AS (SELECT campaign_id, day_index, count(DISTINCT outlet_id) AS u, count(DISTINCT place) AS c, count(DISTINCT tongue) AS l FROM rows_ WHERE day_index IS NOT NULL GROUP BY 1, 2)
SELECT campaign_id, day_index, n AS article_count, ca::BIGINT AS cumulative_articles, coalesce(u, 0)::BIGINT AS unique_outlets, coalesce(c, 0)::BIGINT AS countries, coalesce(l, 0)::BIGINT AS languages,
  co::BIGINT AS cumulative_unique_outlets FROM run LEFT JOIN d USING (campaign_id, day_index)""")
def metrics_daily(spark, sf_dir):
    return velocity.metrics_daily(rows(spark, sf_dir))


@query(f"WITH {ROWS}, {DAILY}, {PEAK} SELECT * FROM peak")
def peak(spark, sf_dir):
    return velocity.peaks(velocity.daily_counts(rows(spark, sf_dir)))


@query(f"""WITH {ROWS}, {DAILY}, {PEAK}, {DENSE},
m AS (SELECT *, avg(n) OVER (PARTITION BY campaign_id ORDER BY day_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean FROM dense)
SELECT campaign_id, min(CASE WHEN day_index > peak_day AND mean < 0.1::DOUBLE * peak_volume THEN day_index END) - any_value(peak_day) AS half_life_days FROM m JOIN peak USING (campaign_id) GROUP BY 1""")
def half_life(spark, sf_dir):
    return velocity.half_lives(velocity.daily_counts(rows(spark, sf_dir)))


@query(f"""WITH {ROWS}, {DAILY}, r AS (SELECT *, sum(n) OVER (PARTITION BY campaign_id ORDER BY day_index) AS run, sum(n) OVER (PARTITION BY campaign_id) AS total FROM daily)
SELECT campaign_id, min(CASE WHEN run >= 0.9::DOUBLE * total THEN day_index END) AS days_to_90pct FROM r GROUP BY 1""")
def days_to_90pct(spark, sf_dir):
    return velocity.days_to_most(velocity.daily_counts(rows(spark, sf_dir)))


@query(f"WITH {ROWS}, {DAILY} SELECT campaign_id, coalesce(sum(CASE WHEN day_index > 30 THEN n END), 0) > 0 AS long_tail, coalesce(sum(CASE WHEN day_index > 30 THEN n END), 0)::BIGINT AS late_articles FROM daily GROUP BY 1")
def long_tail(spark, sf_dir):
    return velocity.long_tails(velocity.daily_counts(rows(spark, sf_dir)))


@query(f"""WITH {ROWS}, w AS (SELECT campaign_id, count(*) AS articles_in_window, round(100.0::DOUBLE * count(*) FILTER (place IS NULL) / count(*), 1) AS articles_missing_country_pct FROM rows_ GROUP BY 1),
r AS (SELECT campaign_id, round(100.0::DOUBLE * count(*) FILTER (reach IS NULL) / count(*), 1) AS outlets_missing_reach_pct FROM (SELECT campaign_id, outlet_id, any_value(reach_value) AS reach FROM rows_ GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT campaign_id, count(*) AS articles_total_imported, count(*) FILTER (day_index IS NULL) AS articles_undated, round(100.0::DOUBLE * count(*) FILTER (length(body_text) > 0) / count(*), 1) AS articles_with_body_text_pct FROM articles GROUP BY 1),
l AS (SELECT campaign_id, max(imported_at) AS last_import_at FROM articles a JOIN imports i ON a.import_id = i.id GROUP BY 1)
SELECT * FROM t LEFT JOIN w USING (campaign_id) LEFT JOIN r USING (campaign_id) LEFT JOIN l USING (campaign_id)""")
def data_quality(spark, sf_dir):
    return coverage.data_quality(*(table(spark, sf_dir, t) for t in ("articles", "outlets", "imports")))


@query("SELECT campaign_id, source, count(*) AS articles, max(imported_at) AS last_imported_at, count(DISTINCT i.id) AS imports FROM articles a JOIN imports i ON a.import_id = i.id GROUP BY 1, 2")
def sources_for_campaign(spark, sf_dir):
    return coverage.sources(table(spark, sf_dir, "articles"), table(spark, sf_dir, "imports"))


@query(f"WITH {ROWS} SELECT campaign_id, outlet_id, count(*) AS articles, sum(coalesce(is_original, 0))::BIGINT AS originals FROM rows_ WHERE day_index <= 30 GROUP BY 1, 2")
def outlet_rollup(spark, sf_dir):
    return coverage.outlet_rollup(rows(spark, sf_dir), 30)


@query("SELECT campaign_id, max(day_index) AS last_day FROM articles GROUP BY 1")
def last_observed_day(spark, sf_dir):
    return coverage.last_days(table(spark, sf_dir, "articles"))


@query(f"""WITH {ROWS}, p AS (SELECT * FROM campaigns WHERE id IN (1, 3, 7) AND published_at IS NOT NULL), w AS (SELECT min(m) AS last FROM (SELECT max(day_index) AS m FROM articles WHERE campaign_id IN (1, 3, 7) GROUP BY campaign_id)),
x AS (SELECT rows_.* FROM rows_, w WHERE day_index <= last AND campaign_id IN (SELECT id FROM p))
SELECT p.id AS campaign_id, (SELECT last FROM w)::INTEGER AS at_day_index, count(x.id) AS total_articles, count(DISTINCT x.outlet_id) AS unique_outlets, count(DISTINCT x.story) AS unique_stories
FROM p LEFT JOIN x ON x.campaign_id = p.id GROUP BY 1""")
def compare_at_shortest_window(spark, sf_dir):
    values = comparison.compare(*(table(spark, sf_dir, t) for t in ("articles", "outlets", "campaigns")), [1, 3, 7])
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).cast("long").alias(m)
    return values.groupBy("campaign_id", "at_day_index").agg(pick("total_articles"), pick("unique_outlets"), pick("unique_stories"))


_VALUES = f"""WITH {ROWS}, {DAILY}, {PEAK}, {DENSE},
p AS (SELECT id AS campaign_id, status FROM campaigns WHERE published_at IS NOT NULL),
f AS (SELECT campaign_id, {_FOOT} FROM rows_ GROUP BY 1),
r AS (SELECT campaign_id, sum(reach)::DOUBLE AS total_reach FROM (SELECT campaign_id, outlet_id, any_value(reach_value) AS reach FROM rows_ GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT *, avg(n) OVER (PARTITION BY campaign_id ORDER BY day_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean FROM dense),
h AS (SELECT campaign_id, min(CASE WHEN day_index > peak_day AND mean < 0.1::DOUBLE * peak_volume THEN day_index END) - any_value(peak_day) AS half FROM m JOIN peak USING (campaign_id) GROUP BY 1),
q AS (SELECT *, sum(n) OVER (PARTITION BY campaign_id ORDER BY day_index) AS run, sum(n) OVER (PARTITION BY campaign_id) AS total FROM daily),
n AS (SELECT campaign_id, min(CASE WHEN run >= 0.9::DOUBLE * total THEN day_index END) AS most, max(day_index) > 30 AS tail FROM q GROUP BY 1),
w AS (SELECT p.*, f.* EXCLUDE (campaign_id), total_reach, peak_day, peak_volume, half, most, tail, CASE WHEN peak_day IS NULL THEN 'no dated articles' END AS undated
  FROM p LEFT JOIN f USING (campaign_id) LEFT JOIN r USING (campaign_id) LEFT JOIN peak USING (campaign_id) LEFT JOIN h USING (campaign_id) LEFT JOIN n USING (campaign_id))"""


def _value_sql(metric: str, value: str, reason: str = "NULL") -> str:
    return f"SELECT campaign_id, '{metric}' AS metric, CASE WHEN ({reason}) IS NULL THEN ({value})::DOUBLE END AS value, ({reason}) IS NULL AS available, ({reason})::VARCHAR AS reason FROM w"


@query(_VALUES + " " + " UNION ALL ".join(
    [_value_sql(m, f"coalesce({m}, 0)") for m in ("unique_stories", "unique_outlets", "total_articles", "country_count", "language_count")]
    + [_value_sql("long_tail", "coalesce(tail, false)::INTEGER"), _value_sql("syndication_ratio", "round(unique_outlets::DOUBLE / nullif(unique_stories, 0), 3)"), _value_sql("total_reach", "total_reach")]
    + [_value_sql("reach_coverage", "round(100.0::DOUBLE * outlets_with_reach / nullif(unique_outlets, 0), 1)")]
    + [_value_sql(m, v, "undated") for m, v in (("peak_day", "peak_day"), ("peak_volume", "peak_volume"), ("days_to_peak", "peak_day"))]
    + [_value_sql("half_life_days", "half", "coalesce(undated, CASE WHEN half IS NULL THEN 'not below a tenth of the peak yet' END)")]
    + [_value_sql("days_to_90pct", "most", "coalesce(undated, CASE WHEN status IN ('live', 'pre_publication') THEN 'the campaign is not over' END)")]
))
def metric_values(spark, sf_dir):
    return comparison.metric_values(*(table(spark, sf_dir, t) for t in ("articles", "outlets", "campaigns")), None)


@query("""SELECT c.id AS campaign_id, c.slug, (SELECT count(*) FROM articles a WHERE a.campaign_id = c.id) AS articles, (SELECT count(DISTINCT outlet_id) FROM articles a WHERE a.campaign_id = c.id) AS outlets,
(SELECT max(published_at) FROM articles a WHERE a.campaign_id = c.id) AS last_published_at FROM campaigns c""")
def campaign_summaries(spark, sf_dir):
    return comparison.summaries(table(spark, sf_dir, "campaigns"), table(spark, sf_dir, "articles"))


_MENTIONS = """m AS (SELECT event_id AS id, user_id % 4 AS campaign_id, user_id AS article_id, user_id % 3 AS entity_id,
CASE event_type WHEN 'purchase' THEN 'subject' WHEN 'signup' THEN 'named_supplier' WHEN 'click' THEN 'named_buyer' WHEN 'error' THEN 'quoted_response' WHEN 'view' THEN 'passing_reference' END AS role,
(date_diff('day', DATE '2024-01-01', ts::DATE) - 3 * (user_id % 4))::INTEGER AS day_index FROM events)"""
_WEIGHTS = "wt(role, weight) AS (VALUES ('subject', 5), ('named_supplier', 3), ('named_buyer', 3), ('quoted_response', 2), ('passing_reference', 1))"


def own_mentions(spark, sf_dir):
    return adapters.mentions(spark, sf_dir).where("is_own")


@query(f"""WITH {_MENTIONS}, {_WEIGHTS}, c AS (SELECT DISTINCT campaign_id FROM m WHERE entity_id = 0), n AS (SELECT campaign_id, role, count(*) AS n FROM m WHERE entity_id = 0 GROUP BY 1, 2)
SELECT campaign_id, role, weight::INTEGER AS weight, coalesce(n, 0)::BIGINT AS mentions, (coalesce(n, 0) * weight)::BIGINT AS points FROM c CROSS JOIN wt LEFT JOIN n USING (campaign_id, role)""")
def mentions_by_role(spark, sf_dir):
    return exposure.mentions_by_role(own_mentions(spark, sf_dir))


@query(f"WITH {_MENTIONS}, {_WEIGHTS} SELECT campaign_id, count(*) AS own_company_mentions, count(DISTINCT article_id) AS articles_mentioning, sum(weight)::BIGINT AS depth_score FROM m JOIN wt USING (role) WHERE entity_id = 0 GROUP BY 1")
def depth_score(spark, sf_dir):
    return exposure.depth_score(own_mentions(spark, sf_dir))


@query(f"WITH {_MENTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY day_index, id) AS k FROM m WHERE entity_id = 0) SELECT campaign_id, day_index AS first_mention_day, id AS mention_id, article_id, role FROM r WHERE k = 1")
def first_mention(spark, sf_dir):
    return exposure.first_mention(own_mentions(spark, sf_dir))


@query(f"""WITH {_MENTIONS}, c AS (SELECT campaign_id, entity_id, count(*) AS n FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY n DESC, (entity_id = 0) DESC, entity_id) AS k, count(*) OVER (PARTITION BY campaign_id) AS s FROM c)
SELECT campaign_id, k::INTEGER AS own_rank, s::INTEGER AS entities_compared, CASE WHEN s = 1 THEN 'no competitors configured' WHEN k = 1 THEN 'named most' WHEN k = s THEN 'named least' ELSE 'named alongside peers' END AS standing
FROM r WHERE entity_id = 0""")
def peer_standing(spark, sf_dir):
    return exposure.peer_standing(adapters.mentions(spark, sf_dir))


_ESCALATIONS = """e AS (SELECT o_orderkey AS id, o_custkey % 4 AS campaign_id, o_orderdate AS occurred_at,
['legal_petition', 'parliamentary_question', 'certifier_response', 'retailer_statement', 'buyer_statement', 'regulatory_action', 'customs_measure', 'company_response', 'other'][1 + o_orderkey % 9] AS escalation_type,
6 - o_orderpriority[1]::INTEGER AS severity, o_orderstatus = 'F' AS verified, (date_diff('day', DATE '1995-01-01', o_orderdate::DATE) - 90 * (o_custkey % 4))::INTEGER AS day_index FROM orders)"""
_STAGE = """CASE WHEN escalation_type = 'legal_petition' THEN 1 WHEN escalation_type IN ('parliamentary_question', 'certifier_response') THEN 2 WHEN escalation_type IN ('retailer_statement', 'buyer_statement') THEN 3
WHEN escalation_type IN ('regulatory_action', 'customs_measure') THEN 4 END"""
_NAMES = "['publication', 'ngo_action', 'institutional_query', 'market_action', 'regulatory_action']"


@query(f"WITH {_ESCALATIONS} SELECT campaign_id, escalation_type, count(*) AS n, count(*) FILTER (verified) AS verified, sum(severity)::BIGINT AS severity FROM e GROUP BY 1, 2")
def escalation_summary(spark, sf_dir):
    return escalation.summary(adapters.escalations(spark, sf_dir))


@query(f"WITH {_ESCALATIONS} SELECT campaign_id, count(*) AS escalation_count, sum(severity)::BIGINT AS severity_weighted_total, min(day_index) AS days_to_first_escalation FROM e GROUP BY 1")
def escalation_totals(spark, sf_dir):
    return escalation.totals(adapters.escalations(spark, sf_dir))


@query(f"WITH {_ESCALATIONS}, s AS (SELECT *, {_STAGE} AS k FROM e) SELECT campaign_id, {_NAMES}[k + 1] AS stage, min(occurred_at) AS first_at, count(*) AS escalations FROM s WHERE k IS NOT NULL GROUP BY campaign_id, k")
def escalation_chain(spark, sf_dir):
    return escalation.chain(adapters.escalations(spark, sf_dir))


@query(f"WITH {_ESCALATIONS}, s AS (SELECT campaign_id, max({_STAGE}) AS k FROM e GROUP BY 1) SELECT id AS campaign_id, {_NAMES}[coalesce(k, 0) + 1] AS escalation_chain FROM campaigns c LEFT JOIN s ON c.id = s.campaign_id WHERE published_at IS NOT NULL")
def furthest_stage(spark, sf_dir):
    published = table(spark, sf_dir, "campaigns").where("published_at is not null").select(F.col("id").alias("campaign_id"))
    return escalation.furthest(adapters.escalations(spark, sf_dir), published)


@query(f"WITH {_ESCALATIONS} SELECT campaign_id, id, day_index, severity, sum(severity) OVER (PARTITION BY campaign_id ORDER BY day_index, occurred_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS running_total FROM e")
def severity_running_total(spark, sf_dir):
    return escalation.running_severity(adapters.escalations(spark, sf_dir))


_LINES = """x AS (SELECT c_mktsegment AS campaign_id, l_suppkey AS outlet_id, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS day_index, c_nationkey::VARCHAR AS place, l_orderkey AS story
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {_LINES} SELECT campaign_id, count(*) AS total_articles, count(DISTINCT outlet_id) AS unique_outlets, count(DISTINCT story) AS unique_stories, count(DISTINCT place) AS country_count FROM x GROUP BY 1""")
def bench_lineitem_footprint(spark, sf_dir):
    return coverage.footprint(adapters.line_rows(spark, sf_dir)).select("campaign_id", "total_articles", "unique_outlets", "unique_stories", "country_count")


@query(f"""WITH {_LINES}, daily AS (SELECT campaign_id, day_index, count(*) AS n FROM x GROUP BY 1, 2), {PEAK} SELECT * FROM peak""")
def bench_lineitem_peak(spark, sf_dir):
    return velocity.peaks(velocity.daily_counts(adapters.line_rows(spark, sf_dir))).withColumn("peak_day", F.col("peak_day").cast("long"))


def _labelled_sql(metric: str, value: str, label: str, reason: str = "NULL") -> str:
    return f"SELECT campaign_id, '{metric}' AS metric, CASE WHEN ({reason}) IS NULL THEN ({value})::DOUBLE END AS value, CASE WHEN ({reason}) IS NULL THEN ({label})::VARCHAR END AS label, ({reason}) IS NULL AS available, ({reason})::VARCHAR AS reason FROM x"


@query(f"""WITH v AS ({SQL['metric_values']}), {ROWS}, {_MENTIONS}, {_WEIGHTS}, {_ESCALATIONS},
n AS (SELECT campaign_id, coalesce(tier, 'unknown') AS tier, count(*) AS n FROM rows_ GROUP BY campaign_id, rows_.tier),
s AS (SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY campaign_id), 4) AS share FROM n),
t AS (SELECT campaign_id, string_agg(tier || ' ' || printf('%.4f', share), ', ' ORDER BY n DESC, tier) AS tiers FROM s GROUP BY 1),
o AS (SELECT campaign_id, count(*) AS own, sum(weight) AS depth, min(day_index) AS first_day FROM m JOIN wt USING (role) WHERE entity_id = 0 GROUP BY 1),
c AS (SELECT campaign_id, entity_id, count(*) AS n FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY n DESC, (entity_id = 0) DESC, entity_id) AS k, count(*) OVER (PARTITION BY campaign_id) AS size FROM c),
g AS (SELECT campaign_id, CASE WHEN size = 1 THEN 'no competitors configured' WHEN k = 1 THEN 'named most' WHEN k = size THEN 'named least' ELSE 'named alongside peers' END AS standing FROM r WHERE entity_id = 0),
q AS (SELECT campaign_id, count(*) AS peers FROM m WHERE entity_id <> 0 GROUP BY 1),
a AS (SELECT campaign_id, count(*) AS escalated, sum(severity) AS severity, min(day_index) AS first_escalation, max({_STAGE}) AS stage FROM e GROUP BY 1),
x AS (SELECT id AS campaign_id, tiers, own, depth, first_day, standing, peers, escalated, severity, first_escalation, stage FROM campaigns LEFT JOIN t ON t.campaign_id = id LEFT JOIN o ON o.campaign_id = id
  LEFT JOIN g ON g.campaign_id = id LEFT JOIN q ON q.campaign_id = id LEFT JOIN a ON a.campaign_id = id WHERE published_at IS NOT NULL)
SELECT campaign_id, metric, value, NULL::VARCHAR AS label, available, reason FROM v UNION ALL """ + " UNION ALL ".join([
    _labelled_sql("tier_mix", "NULL", "tiers", "CASE WHEN tiers IS NULL THEN 'no articles' END"),
    _labelled_sql("own_company_mentions", "coalesce(own, 0)", "NULL"), _labelled_sql("depth_score", "coalesce(depth, 0)", "NULL"),
    _labelled_sql("first_mention_day", "first_day", "NULL", "CASE WHEN first_day IS NULL THEN 'no dated mention' END"),
    _labelled_sql("competitor_comparison", "NULL", "coalesce(standing, CASE WHEN peers > 0 THEN 'named least' ELSE 'no competitors configured' END)"),
    _labelled_sql("escalation_count", "coalesce(escalated, 0)", "NULL"), _labelled_sql("severity_weighted_total", "coalesce(severity, 0)", "NULL"),
    _labelled_sql("days_to_first_escalation", "first_escalation", "NULL", "CASE WHEN first_escalation IS NULL THEN 'no dated escalation' END"),
    _labelled_sql("escalation_chain", "NULL", f"{_NAMES}[coalesce(stage, 0) + 1]"),
]))
def metric_set(spark, sf_dir):
    """All 23 metrics of every published campaign."""
    tables = (table(spark, sf_dir, t) for t in ("articles", "outlets", "campaigns"))
    return comparison.all_metric_values(*tables, None, adapters.mentions(spark, sf_dir), adapters.escalations(spark, sf_dir))
