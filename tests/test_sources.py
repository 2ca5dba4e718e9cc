import pytest

from conftest import rows
from covertrace.sources import archives, feeds, markup, services, tabular


def test_delimited_files_by_their_headers(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('﻿Rubrik;Dato;Medie;Brødtekst\n"A; ""b""";2019-03-04;S;"x\ny"\n', encoding="utf-8")
    seen = tabular.inspect(spark, str(f), tabular.DANISH_HINTS)
    assert seen["delimiter"] == ";" and seen["required_present"] and seen["mapping"]["outlet_name"] == "Medie"
    df = tabular.read_delimited(spark, str(f), defaults=tabular.DANISH_DEFAULTS, hints=tabular.DANISH_HINTS)
    r = df.first()
    assert (r.headline, r.body_text, r.country) == ('A; "b"', "x\ny", "DK")
    (tmp_path / "b.csv").write_text("Headline,Outlet\nA,S\n")
    with pytest.raises(ValueError):
        tabular.read_delimited(spark, str(tmp_path / "b.csv"))


CODED = """HD  First headline
BY  A. Writer
PD  4 March 2019
SN  The Paper
LA  English
LP
Lead line
goes on
TD
Body with https://paper.test/1.

Document PAPER000001
HD  Anden overskrift
PD  6 March 2019
SN  Avisen
LA  Danish
TD  Tekst
Document AVIS000002
"""
LABELLED = """1 of 2 DOCUMENTS
The Paper
March 4, 2019
HEADLINE: First headline
BYLINE: A. Writer
LANGUAGE: ENGLISH
BODY:
One line.

Two https://paper.test/2
LOAD-DATE: March 5, 2019
2 of 2 DOCUMENTS
Avisen
HEADLINE: Second
LOAD-DATE: March 6, 2019
End of Document
"""


def test_archive_blocks(spark, tmp_path):
    a, b = archives.coded_rows(CODED)
    assert a == {"headline": "First headline", "published_at": "4 March 2019", "outlet_name": "The Paper", "byline": "A. Writer", "language": "en", "country": None, "url": "https://paper.test/1", "body_text": "Lead line goes on\n\nBody with https://paper.test/1."}
    assert b["language"] == "da" and b["body_text"] == "Tekst"
    c, d = archives.labelled_rows(LABELLED)
    assert c["outlet_name"] == "The Paper" and c["published_at"] == "March 4, 2019" and c["body_text"] == "One line.\n\nTwo https://paper.test/2" and c["url"] == "https://paper.test/2"
    assert d["published_at"] == "March 6, 2019" and d["outlet_name"] == "Avisen"
    assert archives.coded_rows("nothing here") == [] and archives.labelled_rows("") == []
    (tmp_path / "x.html").write_text("<html><body><p>" + CODED.replace("\n", "<br>") + "</body></html>")
    assert archives.read_blocks(spark, str(tmp_path), archives.coded_rows).count() == 2
    assert archives.looks_tabular("a,b,c,d\n1,2,3,4") and not archives.looks_tabular(LABELLED)


def test_markup():
    rtf = r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\xmlnstbl x;}\f0 K\'f8ber\par\b fisk\b0  \{a\}}"
    assert markup.rtf_text(rtf) == "Køber\nfisk {a}"
    page = "<!doctype html><html><head><title>x</title></head><body><script>no()</script><p>A &amp; b</p><div>c<br>d</div></body></html>"
    assert markup.html_text(page) == "A & b\n\nc\nd"
    assert markup.plain_text(rtf, "f.RTF") == markup.rtf_text(rtf) and markup.plain_text(page) == "A & b\n\nc\nd" and markup.plain_text("plain", "f.txt") == "plain"


RSS = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed</title>
<item><title>One</title><link>https://x.test/1</link><pubDate>Mon, 04 Mar 2019 08:00:00 +0000</pubDate><description>&lt;p&gt;Sum&lt;/p&gt;</description><dc:creator>A</dc:creator></item>
<item><title>Two</title><guid>https://x.test/2</guid></item><item><title>none</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><link href="https://x.test/e"/><updated>2019-03-04T00:00:00Z</updated><author><name>B</name></author></entry></feed>"""
SITEMAP = """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x.test/a/some-story/</loc><lastmod>2019-03-04</lastmod></url></urlset>"""


def test_feeds(spark):
    df = spark.createDataFrame([("r", RSS), ("a", ATOM), ("s", SITEMAP), ("bad", "<!DOCTYPE x><rss/>"), ("worse", "<rss"), ("none", None)], "feed string, body string")
    got = rows(feeds.read_items(df), "feed", "title", "url", "published_at")
    assert got == [("a", "E", "https://x.test/e", "2019-03-04T00:00:00"), ("r", "One", "https://x.test/1", "2019-03-04T08:00:00"), ("r", "Two", "https://x.test/2", None), ("s", "some story", "https://x.test/a/some-story/", "2019-03-04T00:00:00")]
    assert rows(feeds.feed_errors(df), "feed") == [("bad",), ("none",), ("worse",)]
    assert feeds.items(RSS)[0]["summary"] == "Sum"
    assert feeds.advertised_feeds('<link rel="alternate" type="application/rss+xml" href="/f.xml"><link rel="alternate" href="/no">', "https://x.test/a") == ["https://x.test/f.xml"]


STUB = """
def fetch(options):
    page = int(options.get("pagination_token") or 0)
    return {"articles": [{"title": f"t{page}", "seendate": "20190304T101112Z", "url": f"https://x.test/{page}", "domain": "x.test", "sourcecountry": "Denmark", "language": "Danish"}], "pagination_token": str(page + 1) if page < 2 else None}
"""


def test_news_service_through_a_stub(spark, tmp_path, monkeypatch):
    (tmp_path / "news_stub.py").write_text(STUB)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "news_stub.py"))
    services.register(spark)
    records = spark.read.format("news_service").option("kind", "seen").option("transport", "news_stub:fetch").option("query", "q").load()
    got = rows(services.seen_rows(records), "headline", "published_at", "country", "language")
    assert got == [(f"t{k}", "2019-03-04T10:11:12", "DK", "da") for k in range(3)]
    assert services.hit_cap(records, 3) and not services.hit_cap(records, 4)
    story = spark.createDataFrame([("t", "2019-03-04", "u", "", "m.test", "en", "")], services.SCHEMAS["stories"])
    assert rows(services.story_rows(story), "outlet_name", "body_text") == [("m.test", None)]
