"""How coverage runs over days: dense series, peaks, decay, cumulative counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from covertrace.operators.coverage import within

#: Days of the trailing mean, the share of the peak it must fall below, the share of all articles, the last early day.
TRAILING, DECAYED, MOST, EARLY = 3, 0.1, 0.9, 30


def daily_counts(rows: DataFrame, cutoff: int | None = None) -> DataFrame:
    """(campaign_id, day_index, n) of days with coverage."""
    return rows.where(within(cutoff) & F.col("day_index").isNotNull()).groupBy("campaign_id", "day_index").agg(F.count("*").alias("n"))


def dense_series(daily: DataFrame) -> DataFrame:
    """Every day from the first to the last with coverage, absent ones with 0."""
    span = daily.groupBy("campaign_id").agg(F.min("day_index").alias("lo"), F.max("day_index").alias("hi"))
    days = span.select("campaign_id", F.explode(F.sequence("lo", "hi")).alias("day_index"))
    return days.join(daily, ["campaign_id", "day_index"], "left").select("campaign_id", "day_index", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def peaks(daily: DataFrame) -> DataFrame:
    """(campaign_id, peak_day, peak_volume): the earliest day of the largest count."""
    best = F.max_by(F.struct("day_index", "n"), F.struct("n", (-F.col("day_index")).alias("early")))
    return daily.groupBy("campaign_id").agg(best.alias("b")).select("campaign_id", F.col("b.day_index").alias("peak_day"), F.col("b.n").alias("peak_volume"))


def half_lives(daily: DataFrame) -> DataFrame:
    """(campaign_id, half_life_days): days from the peak to the first day whose trailing mean is under a tenth of it; null: not decayed.

    The mean runs over up to three days of the dense series, ending with the day.
    """
    trailing = F.avg("n").over(W.partitionBy("campaign_id").orderBy("day_index").rowsBetween(1 - TRAILING, 0))
    series = dense_series(daily).withColumn("mean", trailing).join(peaks(daily), "campaign_id")
    crossed = F.min(F.when((F.col("day_index") > F.col("peak_day")) & (F.col("mean") < DECAYED * F.col("peak_volume")), F.col("day_index")))
    return series.groupBy("campaign_id").agg((crossed - F.min("peak_day")).alias("half_life_days"))


def days_to_most(daily: DataFrame) -> DataFrame:
    """(campaign_id, days_to_90pct): the first day by which nine tenths of the dated articles are out."""
    w = W.partitionBy("campaign_id").orderBy("day_index")
    run = daily.withColumn("run", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy("campaign_id")))
    return run.groupBy("campaign_id").agg(F.min(F.when(F.col("run") >= MOST * F.col("total"), F.col("day_index"))).alias("days_to_90pct"))


def long_tails(daily: DataFrame) -> DataFrame:
    """(campaign_id, long_tail, late_articles)."""
    late = F.coalesce(F.sum(F.when(F.col("day_index") > EARLY, F.col("n"))), F.lit(0))
    return daily.groupBy("campaign_id").agg((late > 0).alias("long_tail"), late.cast("long").alias("late_articles"))


def cumulative_series(rows: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Running articles, outlets and countries per day of the dense series.

    A running distinct count is the running sum of keys first seen on a day.
    """
    inside = rows.where(within(cutoff) & F.col("day_index").isNotNull())
    series = dense_series(daily_counts(inside))
    for key, name in (("outlet_id", "new_outlets"), ("place", "new_countries")):
        first = inside.where(F.col(key).isNotNull()).groupBy("campaign_id", key).agg(F.min("day_index").alias("day_index"))
        series = series.join(first.groupBy("campaign_id", "day_index").agg(F.count("*").alias(name)), ["campaign_id", "day_index"], "left")
    w = W.partitionBy("campaign_id").orderBy("day_index").rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w).cast("long")
    return series.select(
        "campaign_id", "day_index", "n", total("n").alias("cumulative_articles"), total("new_outlets").alias("cumulative_outlets"), total("new_countries").alias("cumulative_countries")
    )


def metrics_daily(rows: DataFrame) -> DataFrame:
    """The daily snapshot of every campaign: counts of the day and running counts, every day from first to last."""
    dated = rows.where(F.col("day_index").isNotNull())
    day = dated.groupBy("campaign_id", "day_index").agg(F.countDistinct("outlet_id").alias("unique_outlets"), F.countDistinct("place").alias("countries"), F.countDistinct("tongue").alias("languages"))
    run = cumulative_series(rows)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("unique_outlets", "countries", "languages")]
    return run.join(day, ["campaign_id", "day_index"], "left").select(
        "campaign_id", "day_index", F.col("n").alias("article_count"), "cumulative_articles", *zero, F.col("cumulative_outlets").alias("cumulative_unique_outlets")
    )
