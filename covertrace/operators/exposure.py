"""Mentions of the own company and its peers: roles, weighted depth, first mention, standing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The weight of each role of a mention.
ROLE_WEIGHTS = {"subject": 5, "named_supplier": 3, "named_buyer": 3, "quoted_response": 2, "passing_reference": 1}


def roles_table(spark) -> DataFrame:
    return spark.createDataFrame(list(ROLE_WEIGHTS.items()), "role string, weight int")


def mentions_by_role(mentions: DataFrame) -> DataFrame:
    """(campaign_id, role, weight, mentions, points): every role of every campaign with mentions, absent ones with 0."""
    campaigns = mentions.select("campaign_id").distinct()
    frame = campaigns.crossJoin(F.broadcast(roles_table(mentions.sparkSession)))  # five roles for each campaign
    counted = mentions.groupBy("campaign_id", "role").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return frame.join(counted, ["campaign_id", "role"], "left").select("campaign_id", "role", "weight", n.cast("long").alias("mentions"), (n * F.col("weight")).cast("long").alias("points"))


def depth_score(mentions: DataFrame) -> DataFrame:
    """(campaign_id, own_company_mentions, articles_mentioning, depth_score)."""
    weights = F.create_map(*[F.lit(x) for pair in ROLE_WEIGHTS.items() for x in pair])
    return mentions.groupBy("campaign_id").agg(
        F.count("*").alias("own_company_mentions"), F.countDistinct("article_id").alias("articles_mentioning"), F.sum(F.coalesce(weights[F.col("role")], F.lit(0))).cast("long").alias("depth_score")
    )


def first_mention(mentions: DataFrame) -> DataFrame:
    """The earliest dated mention of each campaign; of several of a day the one of the smallest id."""
    row = F.struct("id", "article_id", "role", "day_index")
    best = mentions.where(F.col("day_index").isNotNull()).groupBy("campaign_id").agg(F.min_by(row, F.struct("day_index", "id")).alias("r"))
    return best.select("campaign_id", F.col("r.day_index").alias("first_mention_day"), F.col("r.id").alias("mention_id"), F.col("r.article_id").alias("article_id"), F.col("r.role").alias("role"))


def peer_standing(mentions: DataFrame) -> DataFrame:
    """(campaign_id, own_rank, entities_compared, standing) from mentions with ``entity_id`` and ``is_own``.

    Peers without a mention aren't compared; the own company stands first among equals.
    """
    counts = mentions.groupBy("campaign_id", "entity_id", "is_own").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("campaign_id").orderBy(F.desc("n"), F.desc("is_own"), "entity_id"))).withColumn("size", F.count("*").over(W.partitionBy("campaign_id")))
    own = ranked.where("is_own")
    label = F.when(F.col("size") == 1, "no competitors configured").when(F.col("rank") == 1, "named most").when(F.col("rank") == F.col("size"), "named least").otherwise("named alongside peers")
    return own.select("campaign_id", F.col("rank").alias("own_rank"), F.col("size").cast("int").alias("entities_compared"), label.alias("standing"))
