"""The log of consequences: counts, the first one, severity, how far along the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The stages of the chain in order, with the types that reach them; publication is stage 0.
STAGES = (("publication", ()), ("ngo_action", ("legal_petition",)), ("institutional_query", ("parliamentary_question", "certifier_response")),
          ("market_action", ("retailer_statement", "buyer_statement")), ("regulatory_action", ("regulatory_action", "customs_measure")))
STAGE_OF = {t: k for k, (_, types) in enumerate(STAGES) for t in types}


def summary(escalations: DataFrame) -> DataFrame:
    """(campaign_id, escalation_type, n, verified, severity)."""
    return escalations.groupBy("campaign_id", "escalation_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("verified")).alias("verified"), F.sum("severity").cast("long").alias("severity")
    )


def totals(escalations: DataFrame) -> DataFrame:
    """(campaign_id, escalation_count, severity_weighted_total, days_to_first_escalation)."""
    return escalations.groupBy("campaign_id").agg(
        F.count("*").alias("escalation_count"), F.sum("severity").cast("long").alias("severity_weighted_total"), F.min("day_index").alias("days_to_first_escalation")
    )


def chain(escalations: DataFrame) -> DataFrame:
    """(campaign_id, stage, first_at, escalations): each stage reached with its first event; types outside the chain are left out."""
    stage = F.create_map(*[F.lit(x) for t, k in STAGE_OF.items() for x in (t, k)])[F.col("escalation_type")]
    names = F.array(*[F.lit(n) for n, _ in STAGES])
    reached = escalations.withColumn("k", stage).where(F.col("k").isNotNull())
    return reached.groupBy("campaign_id", "k").agg(F.min("occurred_at").alias("first_at"), F.count("*").alias("escalations")).select("campaign_id", names[F.col("k")].alias("stage"), "first_at", "escalations")


def furthest(escalations: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(campaign_id, escalation_chain): the furthest stage of each published campaign; stages may be skipped."""
    stage = F.create_map(*[F.lit(x) for t, k in STAGE_OF.items() for x in (t, k)])[F.col("escalation_type")]
    top = escalations.groupBy("campaign_id").agg(F.max(stage).alias("k"))
    names = F.array(*[F.lit(n) for n, _ in STAGES])
    return campaigns.select("campaign_id").join(top, "campaign_id", "left").select("campaign_id", names[F.coalesce("k", F.lit(0))].alias("escalation_chain"))


def running_severity(escalations: DataFrame) -> DataFrame:
    """Each event with the running total of severity, undated events last."""
    w = W.partitionBy("campaign_id").orderBy(F.col("day_index").asc_nulls_last(), "occurred_at", "id").rowsBetween(W.unboundedPreceding, 0)
    return escalations.select("campaign_id", "id", "day_index", "severity", F.sum("severity").over(w).cast("long").alias("running_total"))
