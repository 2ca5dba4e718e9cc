"""What stands in the way of sound figures: graded findings over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of values that were never filled in; dates that stand for none.
PLACEHOLDERS = ("todo", "example.invalid", "replace with", "placeholder")
SENTINEL_DATES = ("1970-01-01", "2019-01-01", "2020-01-01")
#: Days after which the last import is stale; share of outlets with reach below which it is low; days after which the poller is.
STALE_DAYS, LOW_REACH, POLL_DAYS = 30, 50.0, 2


def _placeholder(c: str) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(c).contains(p) for p in PLACEHOLDERS])


def findings(campaigns: DataFrame, outlets: DataFrame, articles: DataFrame, imports: DataFrame, now: Column) -> DataFrame:
    """(level, code, n): blockers and warnings with the number of rows they concern; a finding without rows doesn't come out.

    Each check is one conditional count; all checks of a table are one pass over it.
    """
    published = F.col("published_at").isNotNull()

    def counted(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
        row = df.agg(*[expr.cast("long").alias(code) for _, code, expr in checks])
        return row.select(F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(code).alias("n")) for level, code, _ in checks])).alias("f")).select("f.*")

    covered = articles.groupBy(F.col("campaign_id").alias("id")).agg(F.count("*").alias("articles"))
    c = campaigns.join(covered, "id", "left")
    on_campaigns = counted(c, [
        ("blocker", "no-campaigns", F.when(F.count("*") == 0, 1).otherwise(0)),
        ("blocker", "placeholder-campaigns", F.count_if(F.coalesce(_placeholder("name"), F.lit(False)) | F.coalesce(_placeholder("publisher_org"), F.lit(False)))),
        ("blocker", "placeholder-dates", F.count_if(F.substring("published_at", 1, 10).isin(*SENTINEL_DATES))),
        ("warning", "imprecise-dates", F.count_if(published & F.col("published_at_precision").isin("month", "year"))),
        ("blocker", "no-coverage", F.count_if(published & F.col("articles").isNull())),
    ])
    with_reach = 100.0 * F.count("reach_value") / F.count("*")
    on_outlets = counted(outlets, [
        ("warning", "no-reach", F.when((F.count("*") > 0) & (F.count("reach_value") == 0), F.count("*")).otherwise(0)),
        ("warning", "low-reach-coverage", F.when((F.count("reach_value") > 0) & (with_reach < LOW_REACH), F.count_if(F.col("reach_value").isNull())).otherwise(0)),
    ])
    on_imports = counted(imports, [
        ("blocker", "nothing-imported", F.when(F.count("*") == 0, 1).otherwise(0)),
        ("warning", "imports-stale", F.when(F.max("imported_at") < now - F.make_dt_interval(days=F.lit(STALE_DAYS)), 1).otherwise(0)),
    ])
    on_articles = counted(articles, [("warning", "undated-articles", F.count_if(F.col("day_index").isNull()))])
    return reduce(DataFrame.unionByName, [on_campaigns, on_outlets, on_imports, on_articles]).where("n > 0")


def setup_findings(entities: DataFrame, rules: DataFrame, runs: DataFrame, escalations: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """(level, code, n): findings about entities, watch rules, the poller and the hand-kept logs."""

    def counted(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
        row = df.agg(*[F.coalesce(expr, F.lit(0)).cast("long").alias(code) for _, code, expr in checks])
        return row.select(F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.col(code).alias("n")) for level, code, _ in checks])).alias("f")).select("f.*")

    own = F.count_if(F.col("type") == "own_company")
    bare = (F.col("type") == "own_company") & ~F.coalesce(_placeholder("name"), F.lit(False)) & (F.coalesce(F.size(F.from_json("aliases", "array<string>")), F.lit(0)) <= 0)
    unfit = F.coalesce(_placeholder("pattern"), F.lit(False))
    on_entities = counted(entities, [
        ("blocker", "no-own-company", F.when(own == 0, 1)), ("blocker", "ambiguous-own-company", F.when(own > 1, own)),
        ("blocker", "placeholder-own-company", F.when(own == 1, F.count_if((F.col("type") == "own_company") & F.coalesce(_placeholder("name"), F.lit(False))))),
        ("warning", "own-company-no-aliases", F.when(own == 1, F.count_if(bare))), ("warning", "no-competitors", F.when(F.count_if(F.col("type") == "competitor") == 0, 1)),
    ])
    on_rules = counted(rules, [
        ("warning", "no-watch-rules", F.when(F.count("*") == 0, 1)),
        ("blocker", "placeholder-watch-patterns", F.when(F.count_if(unfit & F.col("enabled")) > 0, F.count_if(unfit))),
        ("warning", "disabled-placeholder-patterns", F.when(F.count_if(unfit & F.col("enabled")) == 0, F.count_if(unfit))),
        ("warning", "watch-rules-failing", F.count_if(F.col("enabled") & F.col("last_error").isNotNull())),
        ("warning", "no-automated-ingest", F.when(F.count_if((F.col("rule_type") == "gdelt_query") & F.col("enabled")) == 0, 1)),
    ])
    last = F.max("finished_at")
    on_runs = counted(runs, [("warning", "poller-never-run", F.when(F.count("*") == 0, 1)), ("warning", "poller-stale", F.when(last < now - F.make_dt_interval(days=F.lit(POLL_DAYS)), 1))])
    on_log = counted(escalations, [("warning", "no-escalations", F.when(F.count("*") == 0, 1))])
    on_signals = counted(signals, [("warning", "placeholder-signals", F.count_if(F.substring("occurred_at", 1, 10) == SENTINEL_DATES[0]))])
    return reduce(DataFrame.unionByName, [on_entities, on_rules, on_runs, on_log, on_signals]).where("n > 0")
