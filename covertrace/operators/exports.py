"""What leaves the engine: comparison and evidence tables, the snapshot document, the briefing."""

from __future__ import annotations

import html
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.operators import coverage
from covertrace.operators.comparison import METRIC_ORDER

#: Rows of evidence in a briefing.
BRIEFING_ROWS = 60


def snapshot_documents(articles: DataFrame, outlets: DataFrame, campaigns: DataFrame, cutoffs: Sequence[int | None] = (None, *coverage.CUTOFFS)) -> DataFrame:
    """(campaign_id, document): each published campaign with its footprint at every cutoff, as JSON."""
    foot = coverage.footprint(coverage.article_rows(articles, outlets), cutoffs)
    entry = F.struct("cutoff", "total_articles", "unique_outlets", "unique_stories", "country_count", "language_count", "total_reach")
    grouped = foot.groupBy("campaign_id").agg(F.array_sort(F.collect_list(entry)).alias("at"))  # one entry a cutoff
    named = campaigns.where(F.col("published_at").isNotNull()).select(F.col("id").alias("campaign_id"), "slug", "status", "published_at")
    return named.join(grouped, "campaign_id", "left").select("campaign_id", F.to_json(F.struct("slug", "status", "published_at", F.coalesce("at", F.array()).alias("at"))).alias("document"))


def briefing_evidence(articles: DataFrame, outlets: DataFrame, imports: DataFrame, campaign_id: int) -> DataFrame:
    """The first rows of a campaign's evidence by (day_index, published_at, id)."""
    ids = articles.where(F.col("campaign_id") == campaign_id).orderBy(F.col("day_index").asc_nulls_last(), "published_at", "id").limit(BRIEFING_ROWS).select("id")
    return coverage.evidence(ids, articles, outlets, imports).orderBy(F.col("day_index").asc_nulls_last(), "published_at", "id")


def briefing_markdown(slug: str, values: dict[str, tuple[float | None, str | None]], rows: Sequence[tuple]) -> str:
    """A briefing from metric values (value, reason) and evidence rows (day, outlet, headline, url)."""
    lines = [f"# {slug}", "", "| Metric | Value |", "| --- | --- |"]
    for name in METRIC_ORDER:
        if name in values:
            value, reason = values[name]
            lines.append(f"| {name} | {'' if value is None and reason is None else f'unavailable: {reason}' if reason else f'{value:g}'} |")
    lines += ["", "## Evidence", ""]
    lines += [f"- day {'?' if day is None else day}: {headline} ({outlet}){f' <{url}>' if url else ''}" for day, outlet, headline, url in rows]
    return "\n".join(lines) + "\n"


def briefing_html(markdown: str) -> str:
    """The briefing as a page; everything is escaped."""
    return f"<!doctype html><meta charset=utf-8><pre>{html.escape(markdown)}</pre>"


def article_table(articles: DataFrame, outlets: DataFrame, imports: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Articles with outlet and provenance for a CSV, all or those of ``ids``."""
    return coverage.evidence(articles.select("id") if ids is None else ids, articles, outlets, imports)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV with a header; quotes doubled, nulls empty."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").csv(path)
