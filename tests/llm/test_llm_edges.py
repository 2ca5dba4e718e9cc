"""Rows of nothing but nulls, repeated rows, and texts of a megabyte, through every operator."""

import pytest

from covertrace.llm import abuse, batch_dedup, encodings, leakage, name_variants, packing, representatives

LONG = "Harbour quota 17 was signed by the union in town. " * 20_000
ARTICLES = "id long, campaign_id long, cluster_id long, outlet_id long, headline string, body_text string, url string, byline string, language string, country string, retrieved_at timestamp"
DOCUMENTS = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def articles(spark):
    whole = (1, 1, 1, 1, "H", "Short text here. And more of it.", "u", "b", "en", "DK", None)
    return spark.createDataFrame([whole, whole, (2, *[None] * 10), (None,) * 11, (3, 1, 1, 1, "H", LONG, None, None, None, None, None), (4, 1, 2, 1, None, "", None, None, None, None, None)], ARTICLES)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(1, "Fine day at the port.", "s", "en"), (1, "Fine day at the port.", "s", "en"), (2, None, None, None), (None, None, None, None), (3, LONG, "s", None), (4, "", "s", None)], DOCUMENTS)


def test_articles(spark, articles):
    assert {r.cluster_id for r in representatives.best_members(articles).collect()} == {1, 2}
    assert batch_dedup.skipped_duplicates(articles, articles.where("id = 3").selectExpr("id + 100 as id", *[c for c in articles.columns if c != "id"])).collect()[0].accepted_id == 3
    assert encodings.damaged_fields(articles).count() == 0


def test_documents(spark, documents):
    items = spark.createDataFrame([(1, "Harbour quota 17 was signed by the union in town.", None, None), (None, None, None, None), (2, "", "", "")], "item_id long, passage string, question string, answer string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked(documents, items).collect()} == {(3, 1)}
    assert leakage.leaked(documents, items.limit(0)).count() == 0
    assert packing.packed(documents).where("n_tokens > 2048").count() == 0
    votes = spark.createDataFrame([(1, 0), (None, None)], "doc_id long, abusive int")
    assert abuse.abuse_scores(documents, votes).count() == 6


def test_names(spark):
    rows = spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (2, "X" * 100_000, "y" * 100_000, "z" * 1000, "w" * 100_000), (3, "  ", "", "", " , @ / ")], "row_id long, outlet_name string, outlet_domain string, url string, byline string")
    outlets = spark.createDataFrame([(1, "The Paper", None), (2, None, "paper.test"), (None, None, None)], "id long, name string, domain string")
    people = spark.createDataFrame([(1, "A B", 1), (2, None, 1), (3, "C D", None), (None, None, None)], "contributor_id long, full_name string, outlet_id long")
    assert name_variants.tied_names(rows, outlets, people).count() == 0
