import pytest
from coverage_rows import frames
from pyspark.sql import functions as F

from conftest import rows
from covertrace.operators import comparison, coverage, doctor, escalation, exports, exposure, velocity


@pytest.fixture(scope="module")
def campaign(spark):
    return frames(spark)


def test_footprint_by_hand(campaign):
    a, o, _, _ = campaign
    one = coverage.footprint(coverage.article_rows(a, o)).first()
    assert (one.total_articles, one.unique_outlets, one.unique_stories, one.country_count, one.language_count) == (12, 9, 8, 5, 2)
    assert one.syndication_ratio == 1.125 and one.total_reach == 200000 and round(one.reach_coverage, 1) == 11.1


def test_footprint_at_cutoffs(campaign):
    a, o, _, _ = campaign
    found = {r.cutoff: r for r in coverage.footprint(coverage.article_rows(a, o), (2, 3, -1)).collect()}
    assert (found[2].total_articles, found[2].unique_outlets) == (5, 5) and found[3].total_articles == 7
    assert found[-1].total_articles == 0 and found[-1].total_reach is None and found[-1].syndication_ratio is None


def test_velocity_by_hand(campaign):
    a, o, _, _ = campaign
    r = coverage.article_rows(a, o)
    daily = velocity.daily_counts(r)
    assert rows(daily, "day_index", "n") == sorted([(0, 2), (1, 2), (2, 1), (3, 2), (4, 1), (5, 1), (6, 1), (12, 1), (35, 1)], key=str)
    assert velocity.peaks(daily).first()[1:] == (0, 2)
    assert velocity.half_lives(daily).first().half_life_days == 9
    assert velocity.half_lives(velocity.daily_counts(r, 3)).first().half_life_days is None
    assert velocity.days_to_most(daily).first().days_to_90pct == 12
    assert velocity.long_tails(daily).first()[1:] == (True, 1)
    assert velocity.metrics_daily(r).count() == 36
    last = velocity.cumulative_series(r).where("day_index = 35").first()
    assert (last.cumulative_articles, last.cumulative_outlets, last.cumulative_countries) == (12, 9, 5)


def test_metric_values_are_refused_with_a_reason(campaign):
    a, o, c, _ = campaign
    at3 = {r.metric: r for r in comparison.metric_values(a, o, c, 3).where("campaign_id = 1").collect()}
    assert not at3["half_life_days"].available and at3["half_life_days"].value is None and "day 3" in at3["half_life_days"].reason
    assert at3["total_reach"].available
    assert comparison.metric_values(a, o, c, None).where("campaign_id = 2").count() == 0
    nothing = {r.metric: r for r in comparison.metric_values(a.limit(0), o, c, None).collect()}
    assert nothing["total_articles"].value == 0 and not nothing["peak_day"].available and nothing["syndication_ratio"].available


def test_every_metric_comes_out_at_the_cutoff(spark, campaign):
    a, o, c, _ = campaign
    m = spark.createDataFrame([(1, 1, 10, 0, True, "subject", 2), (2, 1, 10, 0, True, "subject", 9), (3, 1, 11, 5, False, "subject", 1), (4, 1, 11, 5, False, "subject", 2), (5, 1, 12, 0, True, "subject", None)], "id long, campaign_id long, article_id long, entity_id long, is_own boolean, role string, day_index int")
    e = spark.createDataFrame([(1, 1, "2019-03-06", "legal_petition", 2, True, 2), (2, 1, "2019-03-20", "regulatory_action", 4, True, 16)], "id long, campaign_id long, occurred_at string, escalation_type string, severity int, verified boolean, day_index int")
    at3 = {r.metric: r for r in comparison.all_metric_values(a, o, c, 3, m, e).collect()}
    assert sorted(at3) == sorted(comparison.METRIC_ORDER)
    assert [at3[n].value for n in ("own_company_mentions", "depth_score", "first_mention_day", "escalation_count", "days_to_first_escalation", "severity_weighted_total")] == [1, 5, 2, 1, 2, 2]
    assert [at3[n].label for n in ("tier_mix", "competitor_comparison", "escalation_chain")] == ["national_general 1.0000", "named least", "ngo_action"]
    without = {r.metric: r for r in comparison.all_metric_values(a, o, c, 3).collect()}
    assert sorted(without) == sorted(at3) and not without["depth_score"].available and "mentions" in without["depth_score"].reason and "escalations" in without["escalation_chain"].reason


def test_comparison_arity_and_references(campaign):
    a, o, c, _ = campaign
    with pytest.raises(ValueError):
        comparison.compare(a, o, c, [1])
    with pytest.raises(LookupError):
        comparison.compare(a, o, c, [1, "nowhere"])
    assert {r.at_day_index for r in comparison.compare(a, o, c, ["harbour", 2]).collect()} == {35}


def test_quality_sources_evidence(campaign):
    a, o, c, i = campaign
    q = coverage.data_quality(a, o, i).first()
    assert q.articles_total_imported == 12 and round(q.articles_with_body_text_pct, 1) == 58.3 and round(q.outlets_missing_reach_pct, 1) == 88.9
    assert coverage.sources(a, i).first()[1:3] == ("manual", 12)
    assert coverage.evidence(a.where("day_index = 0").select("id"), a, o, i).count() == 2
    assert exports.briefing_evidence(a, o, i, 1).count() == 12
    assert comparison.summaries(c, a).where("campaign_id = 2").first()[2:] == (0, 0, None)


def test_exposure(spark):
    m = spark.createDataFrame([(1, 1, 10, 0, True, "subject", 4), (2, 1, 10, 0, True, "passing_reference", 1), (3, 1, 11, 5, False, "subject", 0), (4, 2, 12, 0, True, "named_buyer", None)], "id long, campaign_id long, article_id long, entity_id long, is_own boolean, role string, day_index int")
    own = m.where("is_own")
    assert rows(exposure.depth_score(own)) == [(1, 2, 1, 6), (2, 1, 1, 3)]
    assert rows(exposure.first_mention(own)) == [(1, 1, 2, 10, "passing_reference")]
    assert rows(exposure.peer_standing(m)) == [(1, 1, 2, "named most"), (2, 1, 1, "no competitors configured")]
    assert exposure.mentions_by_role(own).count() == 10


def test_escalation(spark):
    e = spark.createDataFrame([(1, 1, "2019-03-20", "regulatory_action", 4, True, 16), (2, 1, "2019-03-10", "other", 1, False, None), (3, 1, "2019-03-08", "legal_petition", 2, False, 4)], "id long, campaign_id long, occurred_at string, escalation_type string, severity int, verified boolean, day_index int")
    assert rows(escalation.totals(e)) == [(1, 3, 7, 4)]
    published = spark.createDataFrame([(1,), (9,)], "campaign_id long")
    assert rows(escalation.furthest(e, published)) == [(1, "regulatory_action"), (9, "publication")]
    assert [r.running_total for r in escalation.running_severity(e).orderBy(F.col("day_index").asc_nulls_last()).collect()] == [2, 6, 7]


def test_doctor_and_exports(campaign):
    a, o, c, i = campaign
    now = F.lit("2020-01-01").cast("timestamp_ntz")
    found = {r.code: (r.level, r.n) for r in doctor.findings(c, o, a, i, now).collect()}
    assert found["placeholder-campaigns"] == ("blocker", 1) and found["imports-stale"] == ("warning", 1) and "no-coverage" not in found
    document = exports.snapshot_documents(a, o, c).collect()
    assert len(document) == 1 and '"total_articles":12' in document[0].document
    text = exports.briefing_markdown("harbour", {"total_articles": (12.0, None), "half_life_days": (None, "too soon")}, [(0, "Outlet 1", "A <b>", None)])
    assert "unavailable: too soon" in text and "&lt;b&gt;" in exports.briefing_html(text)
