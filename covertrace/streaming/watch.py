"""Watched feeds: rules matched to items, new hits once, promotion of waiting campaigns, micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from covertrace.functions.text import domain_of, normalise
from covertrace.session import written

#: Rules are typed by people; up to this many are broadcast, more are joined by a shuffle on the feed.
RULE_LIMIT = 20_000
FEED_TYPES = ("rss", "sitemap")
ITEMS = "feed string, title string, url string, author string, summary string, published_at string"


def with_forms(items: DataFrame) -> DataFrame:
    """Items with the columns that rules are tested against."""
    return items.withColumn("hay", normalise(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))).withColumn("by", normalise(F.coalesce("author", F.lit("")))).withColumn("host", domain_of(F.col("url")))


def rule_matches() -> Column:
    """Whether an item (hay, by, host) satisfies a rule (rule_type, form, target)."""
    typ, form = F.col("rule_type"), F.col("form")
    words = F.split("hay", " ")
    return (
        F.when(typ == "gdelt_query", False)
        .when(typ.isin(*FEED_TYPES), True)
        .when(form == "", False)
        .when(typ == "domain", F.coalesce((F.col("host") == F.col("target")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("target"))), F.lit(False)))
        .when(typ == "byline", F.contains(F.col("by"), form))
        .when(typ == "phrase", F.contains(F.col("hay"), form))
        .otherwise(F.forall(F.split(form, " "), lambda w: F.array_contains(words, w)))
    )


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules with their pattern's comparison form and, for domains, its host."""
    return rules.where("enabled").withColumn("form", normalise(F.coalesce("pattern", F.lit("")))).withColumn("target", F.coalesce(domain_of(F.col("pattern")), F.lower("pattern")))


def rule_feeds(rules: DataFrame) -> DataFrame:
    """(rule_id, feed): a feed rule's own, else the named one, else every enabled feed of its campaign (of all, without one)."""
    enabled = rules.where(F.col("enabled") & (F.col("rule_type") != "gdelt_query"))
    feeds = enabled.where(F.col("rule_type").isin(*FEED_TYPES)).select(F.col("campaign_id").alias("c"), F.col("pattern").alias("feed")).distinct()
    own = enabled.where(F.col("rule_type").isin(*FEED_TYPES)).select("rule_id", F.col("pattern").alias("feed"))
    content = enabled.where(~F.col("rule_type").isin(*FEED_TYPES))
    named = content.where(F.col("source_url").isNotNull()).select("rule_id", F.col("source_url").alias("feed"))
    free = content.where(F.col("source_url").isNull())
    sibling = free.join(feeds, F.col("campaign_id") == F.col("c")).select("rule_id", "feed")
    every = free.where(F.col("campaign_id").isNull()).select("rule_id", F.lit(1).alias("one")).join(feeds.select("feed", F.lit(1).alias("one")).distinct(), "one").select("rule_id", "feed")
    return own.unionByName(named).unionByName(sibling).unionByName(every).distinct()


def hits(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, campaign_id, url, title, occurred_at): the first item of each (rule, URL) that matches.

    Items with ``feed`` meet the rules of that feed by an equi-join; few rules are broadcast.
    """
    ready = prepared_rules(rules).join(rule_feeds(rules), "rule_id").select("rule_id", "campaign_id", "rule_type", "form", "target", "feed")
    few = ready.limit(RULE_LIMIT + 1).count() <= RULE_LIMIT
    met = with_forms(items).join(F.broadcast(ready) if few else ready, "feed").where(rule_matches())
    first = F.min(F.struct(F.coalesce("published_at", F.lit("")).alias("at"), F.coalesce("title", F.lit("")).alias("title")))
    return met.where(F.col("url").isNotNull()).groupBy("rule_id", "campaign_id", "url").agg(first.alias("f")).select("rule_id", "campaign_id", "url", F.col("f.title").alias("title"), F.nullif(F.col("f.at"), F.lit("")).alias("occurred_at"))


def new_hits(found: DataFrame, known: DataFrame) -> DataFrame:
    """Hits whose (rule, URL) isn't known yet."""
    return found.join(known.select("rule_id", "url").distinct(), ["rule_id", "url"], "left_anti")


def promotions(found: DataFrame, rules: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(campaign_id, published_at, rule_id, url): the first hit of a promoting rule on each campaign not published yet."""
    promoting = rules.where("promotes_to_live").select("rule_id")
    waiting = campaigns.where(F.col("published_at").isNull()).select(F.col("id").alias("campaign_id"))
    chances = found.join(F.broadcast(promoting), "rule_id").join(waiting, "campaign_id").where(F.col("occurred_at").isNotNull())
    best = F.min_by(F.struct("rule_id", "url", "occurred_at"), F.struct("occurred_at", "rule_id", "url"))
    return chances.groupBy("campaign_id").agg(best.alias("b")).select("campaign_id", F.col("b.occurred_at").alias("published_at"), F.col("b.rule_id").alias("rule_id"), F.col("b.url").alias("url"))


def _stored(spark, path: str, schema: str) -> DataFrame:
    """A table by its path, empty where nothing was written yet; any other fault in reading it is raised."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


HITS = "rule_id long, campaign_id long, url string, title string, occurred_at string"


def poll(spark, items_dir: str, rules: DataFrame, hits_path: str, checkpoint: str, on_new=None) -> StreamingQuery:
    """Match files of items as they arrive and append new hits to ``hits_path``; what is there is processed, then it ends.

    A batch is idempotent: hits already stored are left out by an anti-join on the stored table. ``on_new`` (an alert
    channel) gets the hits that aren't marked as told, among them those of an earlier batch that
    failed after storing them; they are marked beside the table, under ``<hits_path>-told``, once it returns. So a hit is told at least
    once, and once only unless the run fails between telling and marking. Hits of which ``on_new`` reports an error of every channel stay unmarked.
    """
    stream = spark.readStream.schema(ITEMS).json(items_dir)
    told_path = f"{hits_path.rstrip('/')}-told"

    def store(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        fresh = written(new_hits(hits(batch, rules), _stored(session, hits_path, HITS)))  # fixed before the table it was held against grows
        if not fresh.isEmpty():
            fresh.write.mode("append").parquet(hits_path)
        if on_new is not None:
            due = written(new_hits(_stored(session, hits_path, HITS), _stored(session, told_path, "rule_id long, url string")))
            if not due.isEmpty():
                errors = on_new(due)
                if not errors or not all(errors.values()):
                    due.select("rule_id", "url").write.mode("append").parquet(told_path)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
