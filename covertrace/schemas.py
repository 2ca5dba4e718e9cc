"""Tables of the engine: columns, vocabularies, and checks that split rows into accepted and rejected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

VERSION = 4

# Vocabularies.
CAMPAIGN_TYPES = ("journalism", "ngo_report", "coalition", "regulatory")
CAMPAIGN_STATUSES = ("pre_publication", "live", "decaying", "archived")
PRECISIONS = ("day", "month", "year")
OUTLET_TIERS = ("national_general", "national_business", "trade", "regional", "broadcast", "wire", "aggregator", "ngo", "newsletter", "blog")
ENTITY_TYPES = ("own_company", "competitor", "ngo", "certifier", "customer", "supplier", "regulator")
ROLES = ("subject", "named_supplier", "named_buyer", "quoted_response", "passing_reference")
CLASSIFIERS = ("rule", "llm", "human")
ESCALATION_TYPES = ("legal_petition", "regulatory_action", "customs_measure", "retailer_statement", "buyer_statement", "parliamentary_question", "certifier_response", "company_response", "other")
CHANNELS = ("journalist", "customer", "tender", "investor", "employee", "other")
SOURCES = ("infomedia", "factiva", "nexis", "gdelt", "mediacloud", "rss", "manual")
RULE_TYPES = ("keyword", "phrase", "byline", "domain", "rss", "sitemap", "gdelt_query")
METHODS = ("hash", "title_similarity", "shingle", "manual")
TONES = ("negative", "mixed", "neutral", "positive")

COLUMNS = {
    "campaigns": "id long, name string, slug string, publisher_org string, campaign_type string, status string, published_at string, first_signal_at string, timezone string, themes string, published_at_precision string",
    "outlets": "id long, name string, domain string, country string, language string, tier string, reach_value long, reach_source string, reach_is_estimated int, reach_estimation_method string, is_known_syndication_partner int",
    "imports": "id long, source string, file_name string, file_hash string, imported_at timestamp, row_count long, rows_inserted long, rows_skipped_duplicate long, rows_rejected long, mapping string, created_by string",
    "articles": "id long, campaign_id long, outlet_id long, url string, headline string, published_at string, day_index int, language string, country string, byline string, body_text string, body_hash string, word_count int, cluster_id long, is_original int, import_id long, row_fingerprint string, retrieved_at timestamp",
    "clusters": "id long, campaign_id long, representative_article_id long, method string, member_count long",
    "cluster_members": "cluster_id long, article_id long, method string, similarity double, matched_against_article_id long",
    "entities": "id long, name string, type string, aliases string",
    "mentions": "id long, article_id long, entity_id long, role string, evidence_sentence string, char_offset int, confidence double, classified_by string",
    "escalations": "id long, campaign_id long, occurred_at string, escalation_type string, actor_name string, description string, source_url string, severity int, verified_by string, verified_at string",
    "inbound_signals": "id long, campaign_id long, occurred_at string, channel string, summary string, source_ref string, logged_by string",
    "article_tone": "article_id long, label string, evidence_sentence string, confidence double, classified_by string",
    "metrics_daily": "campaign_id long, date date, day_index int, article_count long, cumulative_articles long, unique_outlets long, cumulative_unique_outlets long, countries long, languages long, own_company_mentions long",
    "watch_rules": "id long, campaign_id long, name string, rule_type string, pattern string, source_url string, enabled boolean, promotes_to_live boolean, last_polled_at timestamp, last_error string",
    "watch_hits": "id long, rule_id long, occurred_at string, detected_at timestamp, matched_url string, matched_title string, matched_excerpt string, raw string, promoted boolean",
    "watch_runs": "id long, started_at timestamp, finished_at timestamp, rules_polled int, hits_new int, errors int, created_by string",
    "publisher_precedents": "id long, campaign_id long, precedent_campaign_id long, rationale string",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(COLUMNS[table])


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _json(column: str) -> str:
    return f"try_parse_json({column}) IS NOT NULL"


# Each check is (reason, condition that a sound row meets); a condition that is null counts as not met.
CHECKS: dict[str, tuple[tuple[str, str], ...]] = {
    "campaigns": (
        ("name", "name IS NOT NULL AND slug IS NOT NULL"), ("campaign_type", _one_of("campaign_type", CAMPAIGN_TYPES)), ("status", _one_of("status", CAMPAIGN_STATUSES)),
        ("published_at", "(status = 'pre_publication') = (published_at IS NULL)"), ("themes", f"themes IS NULL OR {_json('themes')}"), ("precision", _one_of("coalesce(published_at_precision, 'day')", PRECISIONS)),
    ),
    "outlets": (
        ("name", "name IS NOT NULL"), ("tier", _one_of("tier", OUTLET_TIERS)), ("reach_source", "reach_value IS NULL OR reach_source IS NOT NULL"),
        ("reach_method", "coalesce(reach_is_estimated, 0) = 0 OR reach_estimation_method IS NOT NULL"),
    ),
    "imports": (("source", _one_of("source", SOURCES)), ("mapping", f"mapping IS NULL OR {_json('mapping')}")),
    "articles": (("headline", "headline IS NOT NULL"), ("outlet_id", "outlet_id IS NOT NULL AND campaign_id IS NOT NULL")),
    "clusters": (("method", _one_of("method", METHODS)),),
    "cluster_members": (("method", _one_of("method", METHODS)),),
    "entities": (("type", _one_of("type", ENTITY_TYPES)), ("aliases", f"aliases IS NULL OR {_json('aliases')}")),
    "mentions": (
        ("role", _one_of("role", ROLES)), ("evidence", "evidence_sentence IS NOT NULL"), ("classified_by", _one_of("classified_by", CLASSIFIERS)), ("confidence", "classified_by <> 'llm' OR confidence IS NOT NULL"),
    ),
    "escalations": (("escalation_type", _one_of("escalation_type", ESCALATION_TYPES)), ("severity", "severity BETWEEN 1 AND 5"), ("source_url", "length(trim(source_url)) > 0")),
    "inbound_signals": (("channel", _one_of("channel", CHANNELS)),),
    "article_tone": (("label", _one_of("label", TONES)), ("classified_by", _one_of("classified_by", CLASSIFIERS)), ("confidence", "classified_by <> 'llm' OR confidence IS NOT NULL")),
    "watch_rules": (("rule_type", _one_of("rule_type", RULE_TYPES)), ("pattern", "pattern IS NOT NULL")),
    "watch_hits": (("matched_url", "matched_url IS NOT NULL"), ("raw", f"raw IS NULL OR {_json('raw')}")),
    "publisher_precedents": (("self", "campaign_id <> precedent_campaign_id"),),
}
UNIQUE = {"campaigns": ("slug",), "outlets": ("domain",), "entities": ("name",), "mentions": ("article_id", "entity_id", "role", "char_offset"), "cluster_members": ("cluster_id", "article_id"),
          "watch_hits": ("rule_id", "matched_url"), "publisher_precedents": ("campaign_id", "precedent_campaign_id"), "article_tone": ("article_id",)}


def validate(df: DataFrame, table: str, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows with ``reason``, the first check that they fail, or ``unique`` for all but the first of a key.

    Null keys repeat nothing. ``order`` says which of several rows is the first.
    """
    reason = F.lit(None).cast("string")
    for name, condition in reversed(CHECKS.get(table, ())):
        reason = F.when(~F.coalesce(F.expr(condition), F.lit(False)), name).otherwise(reason)
    judged = df.withColumn("reason", reason)
    if keys := UNIQUE.get(table):
        filled = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        k = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("reason").isNotNull(), order if order in df.columns else keys[0]))
        judged = judged.withColumn("_k", k).withColumn("reason", F.when(F.col("reason").isNull() & filled & (F.col("_k") > 1), "unique").otherwise(F.col("reason"))).drop("_k")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
