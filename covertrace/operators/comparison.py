"""Campaigns compared at one day index: cutoff, metric values with availability, the long comparison table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covertrace.operators import coverage, escalation, exposure, velocity

#: Campaigns of one comparison.
LEAST, MOST = 2, 4
# The metrics in their order of display.
METRIC_ORDER = (
    "unique_stories", "unique_outlets", "total_articles", "syndication_ratio", "country_count", "language_count", "tier_mix", "total_reach", "reach_coverage",
    "peak_day", "peak_volume", "days_to_peak", "half_life_days", "days_to_90pct", "long_tail", "own_company_mentions", "depth_score", "first_mention_day",
    "competitor_comparison", "escalation_count", "days_to_first_escalation", "severity_weighted_total", "escalation_chain",
)


def resolve(campaigns: DataFrame, refs: Sequence[str | int]) -> DataFrame:
    """The campaigns that references name: the one of that id, else the one of that slug; a reference that names none is an error."""
    texts = [str(r) for r in refs]
    rows = campaigns.where(F.col("id").cast("string").isin(texts) | F.col("slug").isin(texts)).select("id", "slug").collect()  # at most two a reference
    by_id, by_slug = {str(r["id"]): r["id"] for r in rows}, {r["slug"]: r["id"] for r in rows}
    found = [by_id.get(t, by_slug.get(t)) for t in texts]
    if None in found:
        raise LookupError(f"no campaign {', '.join(t for t, i in zip(texts, found) if i is None)}")
    return campaigns.where(F.col("id").isin(found))


def shortest_window(articles: DataFrame) -> int | None:
    """The cutoff of a comparison without one: the least last day of the campaigns that ``articles`` holds."""
    return coverage.last_days(articles).agg(F.min("last_day")).first()[0]


def metric_values(articles: DataFrame, outlets: DataFrame, campaigns: DataFrame, cutoff: int | None) -> DataFrame:
    """(campaign_id, metric, value, available, reason): footprint and velocity of published campaigns, long.

    A value that can't be computed is unavailable with a reason, never zero; a ratio without a denominator and
    reach without a source are available and null. Unpublished campaigns have no footprint and don't come out.
    """
    published = campaigns.where(F.col("published_at").isNotNull()).select(F.col("id").alias("campaign_id"), "status")
    rows = coverage.article_rows(articles, outlets).join(F.broadcast(published.select("campaign_id")), "campaign_id", "left_semi")
    daily = velocity.daily_counts(rows, cutoff)
    foot = coverage.footprint(rows, (cutoff,)).drop("cutoff")
    wide = (
        published.join(foot, "campaign_id", "left")
        .join(velocity.peaks(daily), "campaign_id", "left")
        .join(velocity.half_lives(daily), "campaign_id", "left")
        .join(velocity.days_to_most(daily), "campaign_id", "left")
        .join(velocity.long_tails(daily).select("campaign_id", F.col("long_tail").cast("int").alias("long_tail")), "campaign_id", "left")
        .withColumn("days_to_peak", F.col("peak_day"))
    )
    undated = F.when(F.col("peak_day").isNull(), "no dated articles")
    not_over = F.when(F.col("status").isin("live", "pre_publication"), "the campaign is not over")
    undecayed = F.when(F.col("half_life_days").isNull(), "not below a tenth of the peak yet" if cutoff is None else f"not below a tenth of the peak by day {cutoff}")
    nothing = F.lit(None).cast("string")

    def one(name: str, reason: Column, zero: bool = False) -> Column:
        value = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if zero else F.col(name).cast("double")
        return F.struct(F.lit(name).alias("metric"), F.when(reason.isNull(), value).alias("value"), reason.isNull().alias("available"), reason.alias("reason"))

    values = [one(n, nothing, True) for n in ("unique_stories", "unique_outlets", "total_articles", "country_count", "language_count", "long_tail")]
    values += [one(n, nothing) for n in ("syndication_ratio", "total_reach", "reach_coverage")]
    values += [one(n, undated) for n in ("peak_day", "peak_volume", "days_to_peak")]
    values += [one("half_life_days", F.coalesce(undated, undecayed)), one("days_to_90pct", F.coalesce(undated, not_over))]
    return wide.select("campaign_id", F.explode(F.array(*values)).alias("m")).select("campaign_id", "m.*")


def all_metric_values(
    articles: DataFrame, outlets: DataFrame, campaigns: DataFrame, cutoff: int | None, mentions: DataFrame | None = None, escalations: DataFrame | None = None
) -> DataFrame:
    """(campaign_id, metric, value, label, available, reason): every metric of ``METRIC_ORDER`` at one cutoff.

    Those that are no number (tier mix, standing, furthest stage) have a ``label``. Mentions and escalations are cut
    as articles are, undated ones left out at a cutoff; where a table is absent, its metrics are unavailable.
    """
    published = campaigns.where(F.col("published_at").isNotNull()).select(F.col("id").alias("campaign_id"))
    within = lambda df: (df if cutoff is None else df.where(F.col("day_index") <= cutoff)).join(F.broadcast(published), "campaign_id", "left_semi")
    rows = within(coverage.article_rows(articles, outlets))
    tier = F.struct((-F.col("articles")).alias("k"), F.coalesce("tier", F.lit("unknown")).alias("tier"), "share")
    tiers = coverage.distribution(rows, "tier", "tier").groupBy("campaign_id").agg(F.sort_array(F.collect_list(tier)).alias("tiers"))
    wide = published.join(tiers, "campaign_id", "left").withColumn("tier_mix", F.concat_ws(", ", F.transform("tiers", lambda t: F.format_string("%s %.4f", t["tier"], t["share"]))))
    nothing = F.lit(None).cast("string")

    def one(name: str, value: Column | None, label: Column | None, reason: Column) -> Column:
        number = F.lit(None).cast("double") if value is None else F.when(reason.isNull(), value.cast("double"))
        text = nothing if label is None else F.when(reason.isNull(), label)
        return F.struct(F.lit(name).alias("metric"), number.alias("value"), text.alias("label"), reason.isNull().alias("available"), reason.alias("reason"))

    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    values = [one("tier_mix", None, F.col("tier_mix"), F.when(F.col("tiers").isNull(), "no articles"))]
    exposed, escalated = ("own_company_mentions", "depth_score", "first_mention_day", "competitor_comparison"), ("escalation_count", "days_to_first_escalation", "severity_weighted_total", "escalation_chain")
    if mentions is None:
        values += [one(n, None, None, F.lit("no table of mentions")) for n in exposed]
    else:
        m = within(mentions)
        own = m.where("is_own")
        wide = wide.join(exposure.depth_score(own).drop("articles_mentioning"), "campaign_id", "left").join(exposure.first_mention(own).select("campaign_id", "first_mention_day"), "campaign_id", "left")
        wide = wide.join(exposure.peer_standing(m).select("campaign_id", "standing"), "campaign_id", "left").join(m.groupBy("campaign_id").agg(F.count_if(~F.col("is_own")).alias("peers")), "campaign_id", "left")
        # an own company without a mention stands behind all peers that have one
        standing = F.coalesce("standing", F.when(F.col("peers") > 0, "named least").otherwise("no competitors configured"))
        values += [one(n, zero(n), None, nothing) for n in exposed[:2]]
        values += [one(exposed[2], F.col(exposed[2]), None, F.when(F.col(exposed[2]).isNull(), "no dated mention")), one(exposed[3], None, standing, nothing)]
    if escalations is None:
        values += [one(n, None, None, F.lit("no table of escalations")) for n in escalated]
    else:
        e = within(escalations)
        wide = wide.join(escalation.totals(e), "campaign_id", "left").join(escalation.furthest(e, published), "campaign_id", "left")
        values += [one(n, zero(n), None, nothing) for n in (escalated[0], escalated[2])]
        values += [one(escalated[1], F.col(escalated[1]), None, F.when(F.col(escalated[1]).isNull(), "no dated escalation")), one(escalated[3], None, F.col(escalated[3]), nothing)]
    further = wide.select("campaign_id", F.explode(F.array(*values)).alias("m")).select("campaign_id", "m.*")
    return metric_values(articles, outlets, campaigns, cutoff).withColumn("label", nothing).unionByName(further)


def compare(
    articles: DataFrame, outlets: DataFrame, campaigns: DataFrame, refs: Sequence[str | int], cutoff: int | None = None, mentions: DataFrame | None = None, escalations: DataFrame | None = None
) -> DataFrame:
    """The long comparison of two to four campaigns in all metrics at one cutoff (without one, the shortest window among them)."""
    if not LEAST <= len(refs) <= MOST:
        raise ValueError(f"a comparison takes {LEAST} to {MOST} campaigns")
    chosen = resolve(campaigns, refs)
    own = articles.join(F.broadcast(chosen.select(F.col("id").alias("campaign_id"))), "campaign_id", "left_semi")
    at = shortest_window(own) if cutoff is None else cutoff
    return all_metric_values(own, outlets, chosen, at, mentions, escalations).withColumn("at_day_index", F.lit(at).cast("int"))


def pre_publication(campaigns: DataFrame, hits: DataFrame) -> DataFrame:
    """(campaign_id, slug, hits): unpublished campaigns with the watch hits so far."""
    waiting = campaigns.where(F.col("published_at").isNull()).select(F.col("id").alias("campaign_id"), "slug")
    counted = hits.groupBy("campaign_id").agg(F.count("*").alias("hits"))
    return waiting.join(counted, "campaign_id", "left").select("campaign_id", "slug", F.coalesce("hits", F.lit(0)).alias("hits"))


def summaries(campaigns: DataFrame, articles: DataFrame) -> DataFrame:
    """(campaign_id, slug, articles, outlets, last_published_at): every campaign, counts 0 without coverage."""
    counted = articles.groupBy("campaign_id").agg(F.count("*").alias("n"), F.countDistinct("outlet_id").alias("o"), F.max("published_at").alias("last_published_at"))
    c = campaigns.select(F.col("id").alias("campaign_id"), "slug")
    return c.join(counted, "campaign_id", "left").select("campaign_id", "slug", F.coalesce("n", F.lit(0)).alias("articles"), F.coalesce("o", F.lit(0)).alias("outlets"), "last_published_at")


def pivoted(values: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Metrics as rows, campaign slugs as columns, formatted: labels as they are, empty for null, no trailing zeros."""
    named = values.join(F.broadcast(campaigns.select(F.col("id").alias("campaign_id"), "slug")), "campaign_id")
    text = F.when(F.col("value").isNull(), "").otherwise(F.regexp_replace(F.format_string("%.3f", "value"), r"\.?0+$", ""))
    return named.groupBy("metric").pivot("slug").agg(F.first(F.coalesce("label", text)))
