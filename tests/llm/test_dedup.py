import random
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import rows
from covertrace import session
from covertrace.llm import batch_dedup as bd
from covertrace.llm.anchors import anchors, skeleton

SCHEMA = "id long, headline string, body_text string, tok string"
NOUNS = "harbour quota vessel ledger permit union court tender cargo buyer inspector crew".split()


def story(seed, n=9):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(NOUNS).title()} {rng.randrange(9999)} of the {rng.choice(NOUNS)} was {rng.choice(('signed', 'weighed', 'denied'))} by {rng.choice(NOUNS)} number {rng.randrange(9999)} in town {rng.randrange(999)}." for _ in range(n))


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(bd, "BUCKETS", 2)


def found(spark, accepted, incoming):
    mk = lambda data: spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    return dict((i, a) for a, i in rows(bd.skipped_duplicates(mk(accepted), mk(incoming))))


def test_all_ways_of_repeating(spark):
    s = story(1)
    sentences = s.split(". ")
    edited = s.replace("signed", "stamped")
    variants = {101: s, 102: s.upper().replace(". ", ".\n\n"), 103: edited, 104: ". ".join(sentences[:5]) + ".", 105: "NEWS – " + s + " We add a paragraph of our own that is new here today.", 106: s.replace("e", "Ã©"), 107: "  " + s.replace(" ", " ")}
    got = found(spark, [(1, "H", s), (2, "Other", story(2)), (3, "H", s)], [(i, "H", b) for i, b in variants.items()])
    assert got == dict.fromkeys(variants, 1)


def test_what_is_not_a_repetition(spark):
    notice = "This story is available to subscribers only. Please log in or start a free trial to continue reading."
    paragraph = " The cooperative has always said that every delivery is weighed twice before it leaves the quay."
    accepted = [(1, "H", story(1)), (2, "A", notice), (3, "B", notice), (4, "Q", story(4) + paragraph), (5, "N", None)]
    incoming = [(101, "H", story(50)), (102, "C", notice), (103, "Z", story(51) + paragraph), (104, "N", None), (105, "E", ""), (106, None, story(52))]
    assert found(spark, accepted, incoming) == {}


def test_copies_under_many_headlines(spark):
    accepted, incoming, wanted = [], [], {}
    for n in (5, 6, 7, 9):  # under headlines of which the text says nothing
        s = story(20 + n)
        accepted += [(1000 * n + i, f"Entirely different {w} {n}", s) for i, w in enumerate(NOUNS[:n])]
        incoming += [(90000 + n, "Else", s), (91000 + n, "Else", s + " A sentence of our own is added to it here.")]
        wanted |= {90000 + n: 1000 * n, 91000 + n: 1000 * n}
    notice = "This story is available to subscribers only. Please log in or start a free trial to continue."
    accepted += [(i, f"{w} headline here", notice) for i, w in enumerate(NOUNS)]
    assert found(spark, accepted, [*incoming, (99999, "Another headline yet", notice)]) == wanted


def test_short_text_under_a_second_headline(spark):
    s = "Ostlalis Mining shares fell by 89 percent once Nyria Watch had published the catch report."
    bare = "In Jorvik 19 percent of soy meal workers earn under 70 million a month, it was found."
    accepted = [(1, "Catch report sinks Ostlalis Mining", s), (2, "How the Halnoris carried hides", bare)]
    assert found(spark, accepted, [(101, "Watchdog: Ostlalis Mining in free fall", s), (102, "How the Halnoris carried hides… – The Courier", bare)]) == {101: 1, 102: 2}


def test_within_the_batch_and_through_others(spark):
    parts = lambda k: (lambda s: (". ".join(s[:7]) + ".", ". ".join(s), ". ".join(s[5:])))(story(k, 12).split(". "))
    first, whole, last = parts(7)
    first2, whole2, last2 = parts(8)
    got = found(spark, [(1, "a", first), (2, "b", whole), (3, "x", story(9))], [(101, "c", last), (102, "t", whole2), (103, "t", whole2), (104, "u", first2)])
    assert got == {101: 1, 103: 102, 104: 102}


def test_many_copies_make_few_rows(spark):
    s = story(3)
    index = bd.TextIndex.temporary(spark)
    index.accept(spark.createDataFrame([(i, "H", s, "x") for i in range(1, 400)], SCHEMA))
    assert index.tokens().count() == len(anchors(s))  # one class, however many copies
    again = index.accept(spark.createDataFrame([(1000, "H", s, "x")], SCHEMA))
    assert rows(again, "id", "root") == [(1000, 1)]


def test_a_false_first_text_does_not_hide_the_true_one(spark):
    s = story(11)
    pieces = s.split(". ")
    # an earlier text has two sentences of it among many of its own
    decoy = ". ".join(pieces[:3]) + ". " + story(12, 11)
    assert found(spark, [(1, "D", decoy), (2, "H", s)], [(101, "H", s)]) == {101: 2}


def test_a_standing_phrase_keeps_few_rows(spark):
    phrase = " The cooperative has always said that every delivery is weighed twice before it leaves the quay."
    texts = [(i, f"H {i}", story(i, 4) + phrase, "x") for i in range(1, 31)]
    index = bd.TextIndex.temporary(spark)
    assert index.accept(spark.createDataFrame(texts, SCHEMA)).count() == 0
    under = index.tokens().groupBy("tok").count().toPandas()["count"]
    assert under.max() == bd.CLASSES + 1 and (under > 1).sum() == 2
    later = spark.createDataFrame([(100, "H", story(77, 4) + phrase, "x"), (101, "H", story(30, 4) + phrase, "x")], SCHEMA)
    assert rows(index.accept(later, spark.createDataFrame(texts, SCHEMA)), "id", "root") == [(101, 30)]


def test_texts_of_standing_phrases_alone_meet(spark):
    phrases = story(500, 10).removesuffix(".").split(". ")
    accepted = [(i, f"H {i}", f"{story(i, 6)} {phrases[i % 10]}. {phrases[(i + 1) % 10]}.") for i in range(1, 61)]  # each phrase in twelve stories
    text = ". ".join(phrases) + "."
    incoming = {1001: ". ".join(phrases[1:]) + ".", 1002: text + " A sentence of our own is added to it here.", 1003: ". ".join(phrases[5:] + phrases[:5]) + "."}
    assert found(spark, [*accepted, (900, "H", text)], [*((i, "H", b) for i, b in incoming.items()), (1004, "H", f"{story(99, 6)} {phrases[0]}. {phrases[1]}.")]) == dict.fromkeys(incoming, 900)
    # the same where the index was full under each token before, and a batch of its own brought the text
    index = bd.TextIndex.temporary(spark)
    mk = lambda data: spark.createDataFrame([(*r, "x") for r in data], SCHEMA)
    index.accept(mk(accepted))
    assert rows(index.accept(mk([(900, "H", text)]), mk(accepted))) == []
    again = index.accept(mk([(1001, "H", incoming[1001])]), mk([*accepted, (900, "H", text)]))
    assert rows(again, "id", "root") == [(1001, 900)]


def test_batches_are_appended_and_history_is_not_read_again(spark, tmp_path, monkeypatch):
    mk = lambda data: spark.createDataFrame([(*r, "x") for r in data], SCHEMA)
    s = story(7, 12).split(". ")
    first, whole, last = ". ".join(s[:7]) + ".", ". ".join(s), ". ".join(s[5:])
    one = mk([(1, "H", story(1)), (2, "I", first), (3, "H", story(1))])
    assert rows(bd.TextIndex(spark, str(tmp_path / "i"), 4).accept(one), "id", "root") == [(3, 1)]
    index = bd.TextIndex(spark, str(tmp_path / "i"), 4)  # opened again
    read = []
    real = bd.read_texts
    monkeypatch.setattr(bd, "read_texts", lambda batch: read.append(batch.count()) or real(batch))
    two = mk([(11, "K", last), (12, "H", story(1) + " A sentence of our own is added to it here."), (13, "M", story(9))])
    assert rows(index.accept(two, one), "id", "root") == [(12, 1)]
    # the whole text draws the two parts of it together
    three = mk([(21, "L", whole), (22, "M", story(9))])
    assert rows(index.accept(three, one.unionByName(two)), "id", "root") == [(21, 2), (22, 13)]
    four = mk([(31, "L", last)])
    assert rows(index.accept(four, one.unionByName(two).unionByName(three)), "id", "root") == [(31, 2)]
    assert read == [3, 2, 1]  # each batch alone is tokenised


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_shuffle_files_go_with_their_statement(spark, tmp_path):
    dirs = [d.toString() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}
    before, set_before = shuffled(), spark.conf.get(CLEANUP, None)
    with session.shuffles_removed(spark):
        spark.range(10000).repartition(4, "id").write.parquet(str(tmp_path / "out"))
    time.sleep(1)  # executors remove their files by themselves
    assert shuffled() <= before and spark.conf.get(CLEANUP, None) == set_before
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10000


def test_what_is_not_read_again_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    real, seen, set_before = bd.written, [], spark.conf.get(CLEANUP, None)
    monkeypatch.setattr(bd, "written", lambda df: seen.append(spark.conf.get(CLEANUP)) or real(df))
    phrases = story(500, 10).removesuffix(".").split(". ")
    mk = lambda ids: spark.createDataFrame([(i, f"H {i}", f"{story(i, 20)} {phrases[i % 10]}. {phrases[(i + 1) % 10]}.", "x") for i in ids], SCHEMA)
    accepted, index = mk(range(1, 121)), bd.TextIndex(spark, str(tmp_path / "index"))
    for batch in (accepted, mk(range(200, 260))):
        found = index.accept(batch, accepted)
        kept = [p for p in tmp_path.rglob("*.parquet") if p.is_file() and "index" not in p.parts]
        assert not {"toks", "heads", "words", "mine"} & {c for p in kept for c in pq.read_schema(p).names}
        assert rows(found) == rows(found) == []  # what it returns can still be read, and again
    assert set(seen) == {"true"} and spark.conf.get(CLEANUP, None) == set_before


def test_the_index_is_probed_without_moving_it(spark, monkeypatch):
    monkeypatch.setattr(bd, "BUCKETS", 8)
    index = bd.TextIndex.temporary(spark)
    index.accept(spark.createDataFrame([(1, "H", story(1), "x")], SCHEMA))
    toks = spark.createDataFrame([(1,)], "tok long").distinct()
    plan = index.tokens().hint("merge").join(toks.hint("merge"), "tok", "left_semi")._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index(":- ") : plan.index("+- Sort", plan.index(":- "))]
    assert "Bucketed: true" in left and "Exchange" not in left


def test_texts_of_other_scripts_meet_by_their_whole(spark):
    russian = "Правительство приняло решение о новых правилах. Порт закрыт до понедельника."
    assert found(spark, [(1, "H", russian)], [(101, "H", russian), (102, "H", "Совсем другой текст о другом порте.")]) == {101: 1}


def test_empty_tables(spark):
    assert found(spark, [], []) == {}


def test_skeletons():
    assert skeleton("Søren leyó café").split() == skeleton("SOREN leyo cafe").split() == skeleton("SÃ¸ren leyÃ³ cafÃ©").split()
    assert anchors(None) == [] and anchors("") == [] and len(anchors("Too short.")) == 1 and len(set(anchors("a" * 100000))) <= 1
