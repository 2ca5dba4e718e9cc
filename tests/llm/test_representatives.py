import random
from datetime import datetime

from conftest import rows
from covertrace.llm import representatives as rep

SCHEMA = "id long, cluster_id long, outlet_id long, headline string, body_text string, url string, byline string, language string, country string, retrieved_at timestamp, extra string"
STORY = ["The harbour closed at noon on Monday.", "Nobody in Vellabury would say who signed the permit.", "Of 120 samples, 7 held traces of soy meal.", "The court set a hearing for the second of May."]
NOTICE = "We use cookies to keep this site free for everyone."


def member(i, body, cluster=1, headline="Harbour closed", url="u", byline="B", language="en", country="DK", at=1):
    return (i, cluster, i, headline, body, url, byline, language, country, datetime(2020, 1, at), "x")


def best(spark, *members):
    # the notice stands under other headlines, in articles without a group
    others = [member(900 + k, f"{NOTICE} Story {k} has words of its own here.", None, f"Other headline number {w}") for k, w in enumerate(("one", "two", "three", "four"))]
    return dict(rows(rep.best_members(spark.createDataFrame([*members, *others], SCHEMA))))


def test_whole_readable_and_nothing_else(spark):
    text = " ".join(STORY)
    found = best(
        spark, member(1, text + "\n\n" + NOTICE), member(2, " ".join(STORY[:3])), member(3, " ".join(STORY[:2]) + " Of 120 sam…"), member(4, text.replace("Monday", "MondÃ¥y").replace("closed", "clÃ¸sed")),
        member(5, "\n\n".join(STORY)), member(6, None), member(7, ""),
    )
    assert found == {1: 5}


def test_a_story_copied_outside_its_group_is_still_its_story(spark):
    text = " ".join(STORY * 2)
    outside = [member(50, text, None, headline="Quite another title"), member(51, text, None, headline="And one more besides")]
    assert best(spark, member(1, text), member(2, text, at=2), member(3, text[:150], at=3), *outside) == {1: 2}


def test_filled_cells_then_time_then_id(spark):
    text = " ".join(STORY)
    assert best(spark, member(1, text, url=None), member(2, text, byline="n/a"), member(3, text), member(4, text, at=2), member(5, text, at=2, country=" "), member(6, text, at=2)) == {1: 4}


def test_a_group_without_a_whole_member_still_has_one(spark):
    assert best(spark, member(1, None), member(2, "", at=3), member(10, " ".join(STORY[:2]), 2), member(11, " ".join(STORY[2:]), 2)).keys() == {1, 2}


def test_empty_table(spark):
    assert rep.best_members(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_give_the_consensus_of_all(spark, monkeypatch):
    monkeypatch.setattr(rep, "BLOCK", 4)
    rng = random.Random(2)
    data = []
    for i in range(60):
        keep = [s for s in STORY if rng.random() < 0.8] or STORY[:1]
        data.append(member(i, " ".join(keep) + f" Desk note {i} ends here."[: 30 * (i % 2)]))
    data.append(member(99, " ".join(STORY)))
    chosen = best(spark, *data)[1]
    assert set(STORY) <= {s for s in STORY if s in dict((d[0], d[4]) for d in data)[chosen]}


def test_alignment_keeps_order_and_votes():
    words = lambda text: rep.Profile([{h: [1, n, head, tail]} for h, head, tail, n, cut in rep.tokens(text) if not cut])
    p = words(" ".join(STORY))
    p.merge(words(" ".join([STORY[0], STORY[2], STORY[3]])))
    p.merge(words(" ".join(STORY[1:])))
    p.merge(words(" ".join([STORY[0], STORY[1].replace("signed", "wrote"), STORY[3]])))
    assert [k for k, _ in p.consensus()] == [t[0] for t in rep.tokens(" ".join(STORY))]
    assert rep.Profile.load(p.dump()).consensus() == p.consensus()
