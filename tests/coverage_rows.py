"""A small campaign, counted by hand: 12 articles, 9 outlets, 8 stories, days 0 to 35."""

SAME = "The cooperative said on Monday that every delivery had been weighed twice and that nothing was missing from the hold at all."
# (id, outlet, day, headline, body, country, language, cluster)
ARTICLES = [
    (1, 1, 0, "Fish meal traced to closed harbour", SAME, "DK", "en", 1), (2, 2, 0, "Harbour closed after report", SAME, "GB", "en", 1), (3, 3, 1, "Report names closed harbour", SAME, "NO", "en", 1),
    (4, 4, 1, "Closed harbour named in report", SAME, "NL", "en", 1), (5, 5, 2, "Buyers ask for proof of origin after report", "Short note.", "FR", "fr", 2),
    (6, 6, 3, "Buyers ask for proof of origin, after report", "Another note entirely.", "DK", "en", 2), (7, 7, 3, "Minister promises inspection", None, "DK", "en", None),
    (8, 8, 4, "Union wants crew lists", "Crew lists have been kept since spring, the union says, and should be opened to all inspectors now.", "GB", "en", None),
    (9, 9, 5, "Retailer pauses orders", None, "NO", "en", None), (10, 1, 6, "Port opens its books", None, "DK", "en", None), (11, 2, 12, "Two weeks on, few answers", None, "GB", "en", None),
    (12, 3, 35, "A month later the quay is empty", None, "NL", "en", None),
]


def frames(spark):
    """(articles, outlets, campaigns, imports) of the campaign."""
    from datetime import date, datetime, timedelta

    day0 = date(2019, 3, 4)
    articles = [
        (i, 1, o, f"https://outlet{o}.test/{i}", h, (day0 + timedelta(d)).isoformat(), d, lang, c, None, b, None if b is None or len(b) < 40 else str(hash(b)), None, k, 1, 1)
        for i, o, d, h, b, c, lang, k in ARTICLES
    ]
    a = spark.createDataFrame(articles, "id long, campaign_id long, outlet_id long, url string, headline string, published_at string, day_index int, language string, country string, byline string, body_text string, body_hash string, word_count int, cluster_id long, is_original int, import_id long")
    o = spark.createDataFrame([(k, f"Outlet {k}", f"outlet{k}.test", None, None, "national_general", 200000 if k == 1 else None, None) for k in range(1, 10)], "id long, name string, domain string, country string, language string, tier string, reach_value long, reach_is_estimated int")
    c = spark.createDataFrame([(1, "Harbour", "harbour", "archived", "2019-03-04", "day", "Org"), (2, "Waiting", "waiting", "pre_publication", None, "day", "TODO")], "id long, name string, slug string, status string, published_at string, published_at_precision string, publisher_org string")
    i = spark.createDataFrame([(1, "manual", datetime(2019, 5, 1))], "id long, source string, imported_at timestamp_ntz")
    return a, o, c, i
