from datetime import date, datetime

from pyspark.sql import functions as F

from conftest import rows
from covertrace.functions import dates, text


def test_comparison_form_and_tokens(spark):
    df = spark.createDataFrame([(1, "Fjord-Råd: ﬁsk & CHIPS!"), (2, None), (3, "")], "id int, t string").withColumn("f", text.normalise("t"))
    assert [r.f for r in df.orderBy("id").collect()] == ["fjord rad fisk chips", "", ""]
    one = df.where("id = 1").select(text.title_tokens(F.col("f")).alias("a"), text.shingles(F.col("f")).alias("s"), text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j")).first()
    assert one.a == ["fjord", "rad", "fisk", "chips"] and one.s == ["fjord rad fisk chips"] and one.j == 0.5
    assert df.where("id = 2").select(text.shingles(F.col("f")).alias("s")).first().s == []
    long = spark.createDataFrame([("a b c d e f",)], "f string").select(text.shingles(F.col("f")).alias("s"), text.body_hash(F.col("f")).alias("h")).first()
    assert long.s == ["a b c d e", "b c d e f"] and long.h is None


def test_small_text_functions(spark):
    cases = ["https://www.News.test:80/a?b", "user@host.test/x", "Nordic Daily", None, ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, u string").orderBy("i")
    assert [r[0] for r in df.select(text.domain_of(F.col("u"))).collect()] == ["news.test", "host.test", "nordic daily", None, None]
    counts = spark.createDataFrame([(0, " a  b\nc "), (1, ""), (2, "  "), (3, None)], "i int, t string").orderBy("i").select(text.word_count(F.col("t")))
    assert [r[0] for r in counts.collect()] == [3, None, 0, None]
    slugs = spark.createDataFrame([(0, "Soy & Møl: 2"), (1, "!!")], "i int, t string").orderBy("i").select(text.slug(F.col("t")))
    assert [r[0] for r in slugs.collect()] == ["soy-møl-2", "campaign"]
    assert text.sentence_around("One. Two is here! Three", 6) == "Two is here!" and text.sentence_around(None, 3) == ""


def test_wall_clocks_and_day_indexes(spark):
    cases = [
        ("2019-03-04T01:30:00+01:00", datetime(2019, 3, 4, 1, 30)), ("2019-03-04T10:00:00Z", datetime(2019, 3, 4, 10)), ("04/03/2019", datetime(2019, 3, 4)), ("3/14/2019", datetime(2019, 3, 14)),
        ("4 March 2019", datetime(2019, 3, 4)), ("March 4, 2019", datetime(2019, 3, 4)), ("2019-03-04 10:11:12.5", datetime(2019, 3, 4, 10, 11, 12, 500000)), ("not a date", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(dates.wall_clock(F.col("t"))).collect()] == [w for _, w in cases]
    day = lambda t: spark.createDataFrame([(t,)], "t string").select(dates.day_index(F.col("t"), F.lit("2019-03-04T00:00:00"), F.lit("Europe/Copenhagen"))).first()[0]
    assert day("2019-03-03T23:30:00Z") == 0 and day("2019-03-03T23:30:00") == -1 and day("2019-03-08") == 4 and day("soon") is None


def test_feed_dates(spark):
    df = spark.createDataFrame([("Wed, 06 Mar 2019 08:00:00 +0100",), ("2019-03-06",)], "t string").select(dates.feed_date(F.col("t")).cast("date").alias("d"))
    assert rows(df) == [(date(2019, 3, 6),), (date(2019, 3, 6),)]
