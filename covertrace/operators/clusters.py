"""Syndicated copies: equal bodies, near-equal titles, near-equal bodies, led by the first article of each."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from covertrace.functions.dates import wall_clock
from covertrace.functions.text import SHINGLE, STOPWORDS, comparison_form

#: Least similarity of titles and of bodies, widest distance in time.
TITLES, BODIES, DAYS = 0.9, 0.7, 3

LED = "id long, campaign_id long, leader_id long, method string, similarity double"


def hash_clusters(articles: DataFrame) -> DataFrame:
    """(id, campaign_id, leader_id, members): articles of a campaign with one body hash, led by the first published.

    No window in time. Members are joined to their group's leader; the groups are aggregated before the join.
    """
    hashed = articles.where(F.col("body_hash").isNotNull())
    groups = hashed.groupBy("campaign_id", "body_hash").agg(F.count("*").alias("members"), F.min_by("id", F.struct("published_at", "id")).alias("leader_id")).where("members > 1")
    return hashed.select("id", "campaign_id", "body_hash").join(groups, ["campaign_id", "body_hash"]).select("id", "campaign_id", "leader_id", "members")


def _within(a: datetime | None, b: datetime | None) -> bool:
    """Whether two wall clocks lie within the window: whole days of their difference, rounded down."""
    return a is not None and b is not None and abs((a - b).days) <= DAYS


def _shingles(form: str) -> frozenset[str]:
    w = form.split()
    if len(w) < SHINGLE:
        return frozenset([" ".join(w)] if w else [])
    return frozenset(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1))


class Scan:
    """The ordered scan of one stretch of a campaign's articles: each joins its first matching leader or becomes one.

    Leaders are found through their words and shingles; those that have left the window are dropped, so that the
    scan holds a few days' leaders.
    """

    def __init__(self) -> None:
        self.leaders: deque[tuple[int, int, datetime | None, frozenset, frozenset]] = deque()
        self.by_place: dict[int, tuple] = {}
        self.title_index: dict[str, list[int]] = defaultdict(list)
        self.body_index: dict[str, list[int]] = defaultdict(list)
        self.next = 0

    def place(self, article: int, at: datetime | None, title: frozenset, body: frozenset) -> tuple[int, str | None, float]:
        shared_titles: dict[int, int] = defaultdict(int)
        for w in title:
            for k in self.title_index.get(w, ()):
                shared_titles[k] += 1
        shared_bodies: dict[int, int] = defaultdict(int)
        for s in body:
            for k in self.body_index.get(s, ()):
                shared_bodies[k] += 1
        for k in sorted(shared_titles.keys() | shared_bodies.keys()):
            leader, leader_at, leader_title, leader_body = self.by_place[k]
            if not _within(leader_at, at):
                continue
            t = shared_titles.get(k, 0)
            union = len(title) + len(leader_title) - t
            if t and t / union >= TITLES:
                return leader, "title_similarity", t / union
            b = shared_bodies.get(k, 0)
            union = len(body) + len(leader_body) - b
            if b and b / union >= BODIES:
                return leader, "shingle", b / union
        k = self.next
        self.next += 1
        self.by_place[k] = (article, at, title, body)
        self.leaders.append((k, article, at, title, body))
        for w in title:
            self.title_index[w].append(k)
        for s in body:
            self.body_index[s].append(k)
        return article, None, 1.0

    def forget(self, at: datetime | None) -> None:
        """Drop leaders more than the window (and a day for the rounding) before ``at``."""
        while at is not None and self.leaders and self.leaders[0][2] is not None and (at - self.leaders[0][2]).days > DAYS + 1:
            k, _, _, title, body = self.leaders.popleft()
            del self.by_place[k]
            for index, keys in ((self.title_index, title), (self.body_index, body)):
                for key in keys:
                    index[key].remove(k)
                    if not index[key]:
                        del index[key]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scan, stretch = Scan(), None
    stops = frozenset(STOPWORDS)
    for pdf in batches:
        rows = []
        for i, c, s, at, headline, body in zip(*(pdf[x] for x in ("id", "campaign_id", "stretch", "wall", "headline", "body_text"))):
            if (c, s) != stretch:
                scan, stretch = Scan(), (c, s)
            moment = None if pd.isna(at) else at.to_pydatetime()
            scan.forget(moment)
            title = frozenset(w for w in comparison_form(headline).split() if w not in stops)
            leader, method, similarity = scan.place(i, moment, title, _shingles(comparison_form(body)))
            rows.append((i, c, leader, method, similarity))
        yield pd.DataFrame(rows, columns=["id", "campaign_id", "leader_id", "method", "similarity"])


def leader_clusters(articles: DataFrame) -> DataFrame:
    """(id, campaign_id, leader_id, method, similarity): every article not in a hash cluster, with its leader (itself, if none).

    The scan runs in order of (published_at, id) over stretches of a campaign between which nothing was published
    for longer than the window; a stretch is one sorted run of a partition, streamed, never held as a whole.
    Articles whose time can't be read match nothing. Null titles and bodies match nothing.
    """
    rest = articles.join(hash_clusters(articles).select("id"), "id", "left_anti").select("id", "campaign_id", "published_at", "headline", "body_text", wall_clock(F.col("published_at")).alias("wall"))
    # stretches are found from days with articles, not from the articles themselves
    days = rest.where(F.col("wall").isNotNull()).select("campaign_id", F.col("wall").cast("date").alias("day")).distinct()
    w = W.partitionBy("campaign_id").orderBy("day")
    starts = days.withColumn("new", (F.coalesce(F.datediff("day", F.lag("day").over(w)), F.lit(99)) > DAYS + 2).cast("int"))
    stretches = starts.withColumn("stretch", F.sum("new").over(w)).select("campaign_id", "day", "stretch")
    keyed = rest.withColumn("day", F.col("wall").cast("date")).join(stretches, ["campaign_id", "day"], "left").withColumn("stretch", F.coalesce("stretch", F.lit(0)))
    ordered = keyed.repartition("campaign_id", "stretch").sortWithinPartitions("campaign_id", "stretch", "published_at", "id")
    return ordered.select("id", "campaign_id", "stretch", "wall", "headline", "body_text").mapInPandas(_scan, LED)


def cluster_report(led: DataFrame) -> DataFrame:
    """(campaign_id, method, clusters, articles): members by method; leaders count as articles of their cluster."""
    members = led.where(F.col("method").isNotNull())
    return members.groupBy("campaign_id", "method").agg(F.countDistinct("leader_id").alias("clusters"), F.count("*").alias("articles"))
