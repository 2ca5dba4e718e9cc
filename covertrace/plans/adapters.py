"""The supplied star-schema tables as mentions, escalations and large article rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertrace.session import table

# Event types as roles; order classes as escalation types.
ROLES = {"purchase": "subject", "signup": "named_supplier", "click": "named_buyer", "error": "quoted_response", "view": "passing_reference"}
TYPES = ("legal_petition", "parliamentary_question", "certifier_response", "retailer_statement", "buyer_statement", "regulatory_action", "customs_measure", "company_response", "other")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as mentions: campaign by user, entity 0 the own company, day index from 2024-01-01 and three days a campaign."""
    e = table(spark, sf_dir, "events")
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("event_type")]
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) - 3 * (F.col("user_id") % 4)
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("campaign_id"), F.col("user_id").alias("article_id"), (F.col("user_id") % 3).alias("entity_id"),
        (F.col("user_id") % 3 == 0).alias("is_own"), role.alias("role"), day.cast("int").alias("day_index"),
    )


def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as escalations: severity from the priority, type from the key, day index from 1995 and 90 days a campaign."""
    o = table(spark, sf_dir, "orders")
    kinds = F.array(*[F.lit(t) for t in TYPES])
    campaign = F.col("o_custkey") % 4
    return o.select(
        F.col("o_orderkey").alias("id"), campaign.alias("campaign_id"), F.col("o_orderdate").alias("occurred_at"), kinds[(F.col("o_orderkey") % 9).cast("int")].alias("escalation_type"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("severity"), (F.col("o_orderstatus") == "F").alias("verified"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) - 90 * campaign).cast("int").alias("day_index"),
    )


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order and customer as article rows: campaign by market segment, outlet by supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"])
    return joined.select(
        F.col("c_mktsegment").alias("campaign_id"), F.col("l_suppkey").alias("outlet_id"), F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("day_index"),
        F.col("c_nationkey").cast("string").alias("place"), F.lit(None).cast("string").alias("tongue"), F.col("l_orderkey").alias("story"), F.lit(None).cast("long").alias("reach_value"),
    )
