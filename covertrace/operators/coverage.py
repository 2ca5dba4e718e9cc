"""Which articles count at a cutoff, and the footprint of campaigns: volume, outlets, stories, places, reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cutoffs of the standing comparison, besides the whole lifetime.
CUTOFFS = (7, 14, 30, 90)
#: Places to which ratios, shares and percentages are rounded.
RATIO_PLACES, SHARE_PLACES, PERCENT_PLACES = 3, 4, 1


def filled(value: Column, fallback: Column) -> Column:
    """``value``, else ``fallback``; an empty string counts as missing."""
    return F.coalesce(F.nullif(value, F.lit("")), F.nullif(fallback, F.lit("")))


def article_rows(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Articles with what their outlet lends them; bodies aren't read. Outlets are a fixed register, broadcast by size."""
    a = articles.select("id", "campaign_id", "outlet_id", "day_index", "cluster_id", "country", "language", "published_at", "is_original", "import_id")
    o = outlets.select(F.col("id").alias("o_id"), "tier", "reach_value", "reach_is_estimated", F.col("country").alias("o_country"), F.col("language").alias("o_language"))
    return (
        a.join(o, a["outlet_id"] == o["o_id"])
        .withColumn("place", filled(F.col("country"), F.col("o_country")))
        .withColumn("tongue", filled(F.col("language"), F.col("o_language")))
        .withColumn("story", F.coalesce(F.col("cluster_id"), -F.col("id")))
    )


def within(cutoff: int | None) -> Column:
    """The one truncation: dated no later than the cutoff; every row where there is none."""
    return F.lit(True) if cutoff is None else F.coalesce(F.col("day_index") <= cutoff, F.lit(False))


def _first_days(rows: DataFrame, key: str, *extra: Column) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy("campaign_id", key).agg(F.min("day_index").alias("first_day"), *extra)


def _by_cutoff(df: DataFrame, values: dict[str, Column], cutoffs: Sequence[int | None], day: str) -> DataFrame:
    """Aggregates of ``df`` per campaign for each cutoff in one pass, then one row per (campaign, cutoff)."""
    aggs = []
    for k, c in enumerate(cutoffs):
        inside = F.lit(True) if c is None else F.coalesce(F.col(day) <= c, F.lit(False))
        aggs += [F.sum(F.when(inside, v)).alias(f"{name}_{k}") for name, v in values.items()]
    wide = df.groupBy("campaign_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).cast("int").alias("cutoff"), *[F.col(f"{n}_{k}").alias(n) for n in values]) for k, c in enumerate(cutoffs)])
    return wide.select("campaign_id", F.explode(rows).alias("r")).select("campaign_id", "r.*")


def footprint(rows: DataFrame, cutoffs: Sequence[int | None] = (None,)) -> DataFrame:
    """One row per campaign and cutoff (null: lifetime) with the footprint metrics.

    A distinct count at a cutoff is the number of keys first seen by then, so that each key is grouped once for
    all cutoffs and no row is copied per cutoff. Totals without a sourced reach are null, not zero.
    """
    one = F.lit(1).cast("long")
    volume = _by_cutoff(rows, {"total_articles": one}, cutoffs, "day_index")
    outlet = _first_days(rows, "outlet_id", F.first("reach_value").alias("reach"))
    parts = [
        volume,
        _by_cutoff(outlet, {"unique_outlets": one, "total_reach": F.col("reach"), "outlets_with_reach": F.when(F.col("reach").isNotNull(), one)}, cutoffs, "first_day"),
        _by_cutoff(_first_days(rows, "story"), {"unique_stories": one}, cutoffs, "first_day"),
        _by_cutoff(_first_days(rows, "place"), {"country_count": one}, cutoffs, "first_day"),
        _by_cutoff(_first_days(rows, "tongue"), {"language_count": one}, cutoffs, "first_day"),
    ]
    out = parts[0]
    for p in parts[1:]:
        on = (out["campaign_id"] == p["campaign_id"]) & out["cutoff"].eqNullSafe(p["cutoff"])
        out = out.join(p, on, "left").select(out["*"], *[p[c] for c in p.columns if c not in ("campaign_id", "cutoff")])
    counts = ["total_articles", "unique_outlets", "unique_stories", "country_count", "language_count", "outlets_with_reach"]
    out = out.select("campaign_id", "cutoff", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.col("total_reach").cast("long"))
    return out.withColumn("syndication_ratio", F.when(F.col("unique_stories") > 0, F.round(F.col("unique_outlets") / F.col("unique_stories"), RATIO_PLACES))).withColumn(
        "reach_coverage", F.when(F.col("unique_outlets") > 0, F.round(100.0 * F.col("outlets_with_reach") / F.col("unique_outlets"), PERCENT_PLACES))
    )


def distribution(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(campaign_id, name, articles, share) by a key; a missing key stands as null."""
    counted = rows.groupBy("campaign_id", F.col(key).alias(name)).agg(F.count("*").alias("articles"))
    total = rows.groupBy("campaign_id").agg(F.count("*").alias("total"))
    return counted.join(total, "campaign_id").select("campaign_id", name, "articles", F.round(F.col("articles") / F.col("total"), SHARE_PLACES).alias("share"))


def outlet_rollup(rows: DataFrame, cutoff: int | None = None) -> DataFrame:
    """(campaign_id, outlet_id, articles, originals)."""
    return rows.where(within(cutoff)).groupBy("campaign_id", "outlet_id").agg(F.count("*").alias("articles"), F.sum(F.coalesce("is_original", F.lit(0))).cast("long").alias("originals"))


def undated(rows: DataFrame) -> DataFrame:
    return rows.groupBy("campaign_id").agg(F.count_if(F.col("day_index").isNull()).alias("undated"))


def data_quality(articles: DataFrame, outlets: DataFrame, imports: DataFrame, cutoff: int | None = None) -> DataFrame:
    """What is missing, per campaign; the share of bodies is over all articles, whatever the cutoff."""
    rows = article_rows(articles, outlets)
    inside = rows.where(within(cutoff))
    window = inside.groupBy("campaign_id").agg(
        F.count("*").alias("articles_in_window"), F.round(100.0 * F.count_if(F.col("place").isNull()) / F.count("*"), PERCENT_PLACES).alias("articles_missing_country_pct")
    )
    reach = inside.groupBy("campaign_id", "outlet_id").agg(F.first("reach_value").alias("reach")).groupBy("campaign_id").agg(
        F.round(100.0 * F.count_if(F.col("reach").isNull()) / F.count("*"), PERCENT_PLACES).alias("outlets_missing_reach_pct")
    )
    whole = articles.groupBy("campaign_id").agg(
        F.count("*").alias("articles_total_imported"),
        F.count_if(F.col("day_index").isNull()).alias("articles_undated"),
        F.round(100.0 * F.count_if(F.length("body_text") > 0) / F.count("*"), PERCENT_PLACES).alias("articles_with_body_text_pct"),
    )
    last = articles.select("campaign_id", "import_id").distinct().join(imports.select(F.col("id").alias("import_id"), "imported_at"), "import_id").groupBy("campaign_id").agg(F.max("imported_at").alias("last_import_at"))
    return whole.join(window, "campaign_id", "left").join(reach, "campaign_id", "left").join(last, "campaign_id", "left")


def sources(articles: DataFrame, imports: DataFrame) -> DataFrame:
    """(campaign_id, source, articles, last_imported_at, imports): articles are counted per import before the join."""
    per_import = articles.groupBy("campaign_id", "import_id").agg(F.count("*").alias("n"))
    joined = per_import.join(imports.select(F.col("id").alias("import_id"), "source", "imported_at"), "import_id")
    return joined.groupBy("campaign_id", "source").agg(F.sum("n").alias("articles"), F.max("imported_at").alias("last_imported_at"), F.count("*").alias("imports"))


def last_days(articles: DataFrame) -> DataFrame:
    """(campaign_id, last_day): the last day with coverage."""
    return articles.groupBy("campaign_id").agg(F.max("day_index").alias("last_day"))


def evidence(ids: DataFrame, articles: DataFrame, outlets: DataFrame, imports: DataFrame) -> DataFrame:
    """The articles behind a value with outlet, import source and time, by a semi-join on their ids."""
    a = articles.select("id", "campaign_id", "outlet_id", "headline", "published_at", "day_index", "url", "import_id").join(ids.select("id").distinct(), "id", "left_semi")
    o = outlets.select(F.col("id").alias("outlet_id"), F.col("name").alias("outlet_name"))
    i = imports.select(F.col("id").alias("import_id"), "source", "imported_at")
    return a.join(o, "outlet_id").join(i, "import_id").select("id", "campaign_id", "headline", "published_at", "day_index", "url", "outlet_name", "source", "imported_at")
