"""Single changes to the register tables, as rewrites; decisions of people about clusters and mentions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.functions import dates, text


def updated(df: DataFrame, row_id: int, key: str = "id", **values: Any) -> DataFrame:
    """``df`` with the given columns of one row set; other rows and columns stay."""
    hit = F.col(key) == row_id
    return df.withColumns({c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def with_reach(outlets: DataFrame, outlet_id: int, value: int, source: str | None, method: str | None = None) -> DataFrame:
    """Outlets with a reach figure set; it names its source, an estimate its method (in a column that is added if it isn't there)."""
    if not source:
        raise ValueError("a reach figure names its source")
    if "reach_estimation_method" not in outlets.columns:
        outlets = outlets.withColumn("reach_estimation_method", F.lit(None).cast("string"))
    return updated(outlets, outlet_id, reach_value=value, reach_source=source, reach_is_estimated=int(method is not None), reach_estimation_method=method)


def added_campaign(campaigns: DataFrame, name: str, **values: Any) -> DataFrame:
    """Campaigns with a new one: the next id, a slug from its name, waiting unless a publication date is given."""
    top = campaigns.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    status = "live" if values.get("published_at") else "pre_publication"
    given = {"name": name, "status": status, "timezone": "Europe/Copenhagen", "published_at_precision": "day", **values}
    columns = []
    for f in campaigns.schema:
        c = (F.col("top") + 1) if f.name == "id" else text.slug(F.lit(name)) if f.name == "slug" else F.lit(given.get(f.name))
        columns.append(c.cast(f.dataType).alias(f.name))
    return campaigns.unionByName(top.select(*columns))


def reindexed(articles: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Articles with day indexes derived anew from their campaign's publication date and zone."""
    zero = campaigns.select(F.col("id").alias("campaign_id"), F.col("published_at").alias("_zero"), F.col("timezone").alias("_zone"))
    joined = articles.drop("day_index").join(zero, "campaign_id", "left")
    out = joined.withColumn("day_index", dates.day_index(F.col("published_at"), F.col("_zero"), F.col("_zone")))
    return out.select(*articles.columns) if "day_index" in articles.columns else out.drop("_zero", "_zone")


def without_machine_mentions(mentions: DataFrame, articles: DataFrame, campaign_id: int, classified_by: str | None = None) -> DataFrame:
    """Mentions without those of a campaign's articles that people didn't classify (or that a given classifier did)."""
    own = articles.where(F.col("campaign_id") == campaign_id).select(F.col("id").alias("article_id"))
    machine = F.col("classified_by") != "human" if classified_by is None else F.col("classified_by") == classified_by
    gone = mentions.where(machine).join(own, "article_id", "left_semi")
    return mentions.join(gone.select("id"), "id", "left_anti")


def merged_by_hand(members: DataFrame, article_ids: Sequence[int], cluster_id: int, representative: int | None = None) -> DataFrame:
    """Cluster members with a cluster that someone decided on; earlier memberships of its articles stay, as a record."""
    if len(article_ids) < 2:
        raise ValueError("a cluster by hand has at least two articles")
    lead = representative or article_ids[0]
    rows = [(cluster_id, a, "manual", None, None if a == lead else lead) for a in article_ids]
    new = members.sparkSession.createDataFrame(rows, "cluster_id long, article_id long, method string, similarity double, matched_against_article_id long")
    return members.join(new, ["cluster_id", "article_id"], "left_anti").select(*new.columns).unionByName(new)


def split_out(members: DataFrame, article_id: int) -> DataFrame:
    """Cluster members without one article."""
    return members.where(F.col("article_id") != article_id)


def kept_on_reset(members: DataFrame) -> DataFrame:
    """The memberships that a new clustering leaves alone: those by hand."""
    return members.where(F.col("method") == "manual")


def member_counts(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters with their counts taken anew, 0 without members."""
    n = members.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("n"))
    return clusters.drop("member_count").join(n, "id", "left").withColumn("member_count", F.coalesce("n", F.lit(0))).drop("n")


def cluster_view(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """Clusters with their representative's headline, null where it is gone."""
    lead = articles.select(F.col("id").alias("representative_article_id"), "headline", "published_at")
    return clusters.join(lead, "representative_article_id", "left")
