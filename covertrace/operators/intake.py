"""Delivered rows to accepted articles: checks, outlets, natural keys, the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from covertrace.functions import dates, text

FIELDS = ("headline", "published_at", "url", "outlet_name", "outlet_domain", "country", "language", "byline", "body_text", "outlet_tier")
#: Rejected rows kept as samples of an import.
SAMPLES = 50


def normalised(rows: DataFrame, default_tier: str = "blog") -> DataFrame:
    """``rows`` with trimmed fields, the derived outlet, and ``reject_reason`` (null: accepted), the first that applies."""
    out = rows.withColumns({f: text.clean(F.col(f)) for f in FIELDS})
    out = out.withColumn("_wall", dates.wall_clock(F.col("published_at")))
    domain = F.coalesce(text.domain_of(F.col("outlet_domain")), text.domain_of(F.col("url")))
    out = out.withColumn("outlet_domain", domain).withColumn("outlet_name", F.coalesce("outlet_name", "outlet_domain"))
    reason = (
        F.when(F.col("headline").isNull(), "no headline")
        .when(F.col("published_at").isNull(), "no publication date")
        .when(F.col("_wall").isNull(), "unparseable publication date")
        .when(F.col("outlet_name").isNull(), "no outlet name, outlet domain or URL to derive an outlet from")
    )
    return out.withColumn("reject_reason", reason).withColumn("outlet_tier", F.coalesce("outlet_tier", F.lit(default_tier))).drop("_wall")


def outcome_counts(checked: DataFrame) -> DataFrame:
    """(import_id, outcome, n)."""
    return checked.groupBy("import_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def rejection_samples(checked: DataFrame) -> DataFrame:
    """The first ``SAMPLES`` rejected rows of each import with their reason."""
    w = W.partitionBy("import_id").orderBy("row_id")
    return checked.where(F.col("reject_reason").isNotNull()).withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLES).select("import_id", "row_id", "reject_reason", "headline", "published_at", "url", "outlet_name")


def outlet_key(name: Column, domain: Column) -> Column:
    """What identifies an outlet: its domain, or what its name gives as one."""
    return F.coalesce(text.domain_of(domain), text.domain_of(name))


def outlet_matches(checked: DataFrame, outlets: DataFrame) -> DataFrame:
    """(key, outlet_id, first_row_id, rows): each delivered outlet with its register entry, null where it is new.

    A key is looked up by domain, then by name; the first row of a new key would fix its attributes. Keys are
    grouped before the lookup, so that an outlet with most of the rows costs one row.
    """
    keyed = checked.withColumn("key", outlet_key(F.col("outlet_name"), F.col("outlet_domain"))).where(F.col("key").isNotNull())
    grouped = keyed.groupBy("key").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("rows"), F.min_by(F.lower(F.trim("outlet_name")), "row_id").alias("name"))
    by_domain = outlets.where(F.col("domain").isNotNull()).groupBy(F.lower("domain").alias("key")).agg(F.min("id").alias("by_domain"))
    by_name = outlets.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("id").alias("by_name"))
    return grouped.join(by_domain, "key", "left").join(by_name, "name", "left").select("key", F.coalesce("by_domain", "by_name").alias("outlet_id"), "first_row_id", "rows")


def natural_key(df: DataFrame) -> Column:
    """The key of an article within its campaign: its URL, else outlet, body hash (nulls equal) and time."""
    return F.when(F.col("url").isNotNull(), F.struct(F.lit("u").alias("k"), F.col("url").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c"))).otherwise(
        F.struct(F.lit("b").alias("k"), F.col("outlet_id").cast("string").alias("a"), F.col("body_hash").alias("b"), F.col("published_at").alias("c"))
    )


def new_articles(batch: DataFrame, accepted: DataFrame) -> DataFrame:
    """The rows of ``batch`` that insert an article: the first of each natural key, none that was accepted before."""
    keyed = batch.withColumn("_key", natural_key(batch))
    first = keyed.groupBy("campaign_id", "_key").agg(F.min("id").alias("id"))
    known = accepted.select("campaign_id", natural_key(accepted).alias("_key")).distinct()
    kept = first.alias("n").join(known.alias("o"), (F.col("n.campaign_id") == F.col("o.campaign_id")) & F.col("n._key").eqNullSafe(F.col("o._key")), "left_anti")
    return batch.join(kept.select("id"), "id", "left_semi")


def ledger_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """(import_id, row_count, rows_inserted, rows_skipped_duplicate)."""
    seen = batch.groupBy("import_id").agg(F.count("*").alias("row_count"))
    new = inserted.groupBy("import_id").agg(F.count("*").alias("rows_inserted"))
    n = F.coalesce("rows_inserted", F.lit(0))
    return seen.join(new, "import_id", "left").select("import_id", "row_count", n.alias("rows_inserted"), (F.col("row_count") - n).alias("rows_skipped_duplicate"))


def row_fingerprint(rows: DataFrame, columns: list[str]) -> Column:
    """Hash of the filled fields as ``name=value`` in the order of their names."""
    cells = F.array(*[F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(columns)])
    return F.sha2(F.array_join(F.filter(cells, lambda x: x.isNotNull()), "|"), 256)


def fetch_windows(rules: DataFrame, now: Column, lookback_days: int = 7, overlap_hours: int = 24) -> DataFrame:
    """(rule_id, window_start, window_end): from a day before the last success, at most the lookback; without one, the lookback."""
    floor = now - F.make_dt_interval(days=F.lit(lookback_days))
    start = F.greatest(F.col("last_polled_at") - F.make_dt_interval(hours=F.lit(overlap_hours)), floor)
    return rules.select("rule_id", F.coalesce(start, floor).alias("window_start"), now.alias("window_end"))
