"""The best representative of each group of copies: aligned tokens, voted columns, the member nearest to the consensus."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.llm.anchors import skeleton
from covertrace.llm.batch_dedup import headline_words
from covertrace.llm.encodings import Restorer, train_dictionaries
from covertrace.llm.fold import sentences
from covertrace.session import written

#: A sentence under this many different headlines, in as many groups or articles without one, may be no part of a story.
FOREIGN_PLACES = 3
#: It is one all the same in a group of which more than the first share of members hold it, and which has at least the
#: second share of all articles that do.
HELD_SHARE, GROUP_SHARE = 0.5, 0.3
#: Distinct texts of a group that are aligned in one task; larger groups are aligned in blocks, then block by block.
BLOCK = 128
#: Words at a sentence's edge by which two forms of it are known.
EDGE = 3
# Cells that stand for nothing.
NOTHING = ("", "-", "?", "n/a", "na", "none", "null", "nil", "unknown", "n.a.", "tbc", "--", ".")

_WHOLE_END = re.compile(r"[.!?]\s*$")
_CUT_END = re.compile(r"(?:…|\.\.\.)\s*$")
_TEXT_END = re.compile(r"[.!?][\"”»“«’')\]]*\s*$")
_MARKS = ".!?…"
_MARKS_OR_BLANKS = _MARKS + " \n"


def _hash(words: list[str]) -> int:
    h = xxhash.xxh3_64_intdigest(" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def _bit(words: list[str]) -> int:
    """One of 63 bits; different places of a sentence are counted by the bits they set (never more than there are)."""
    return xxhash.xxh3_64_intdigest(" ".join(words)) % 63


def _words(sentence: str) -> list[str]:
    bare = sentence.rstrip(_MARKS_OR_BLANKS)
    if not ("." in bare or "!" in bare or "?" in bare or "…" in bare):  # as in most
        return bare.split()
    return [w for w in (p.strip(_MARKS) for p in sentence.split()) if w]


def token_keys(text: str | None) -> list[int]:
    """The key of each sentence of a text."""
    return [_hash(ws) for s in sentences(skeleton(text)) if (ws := _words(s))]


def tokens(text: str | None) -> list[tuple[int, int, int, int, bool]]:
    """(key, head, tail, words, cut) of each sentence of a text; ``cut`` where it breaks off."""
    out = []
    for s in sentences(skeleton(text)):
        if ws := _words(s):
            out.append((_hash(ws), _hash(ws[:EDGE]), _hash(ws[-EDGE:]), len(ws), bool(_CUT_END.search(s)) or not _WHOLE_END.search(s)))
    if out and not _TEXT_END.search(text or ""):
        out[-1] = (*out[-1][:4], True)
    return out


# -- alignment --------------------------------------------------------------------------------------------------


class Profile:
    """Aligned columns; each holds the forms of one token: key -> [votes, words, head, tail]."""

    def __init__(self, columns: list[dict[int, list[int]]] | None = None):
        self.columns = columns or []

    def merge(self, other: Profile) -> None:
        """Align ``other`` to this profile: columns that share a form or an edge meet; the rest are inserted in their order.

        Of columns that meet, a longest run in the order of both sets where the inserted ones go.
        """
        key_at: dict[int, int] = {}
        edge_at: dict[int, int] = {}
        for k, column in enumerate(self.columns):
            for key, (_, _, head, tail) in column.items():
                key_at.setdefault(key, k)
                for edge in (head, tail):
                    edge_at[edge] = k if edge_at.get(edge, k) == k else -1
        wanted = []
        for column in other.columns:
            place = next((key_at[key] for key in column if key in key_at), None)
            if place is None:
                place = next((edge_at[e] for f in column.values() for e in f[2:] if edge_at.get(e, -1) >= 0), None)
            wanted.append(place)
        kept = _increasing(wanted)
        out: list[dict[int, list[int]]] = []
        at = 0
        for column, place, anchor in zip(other.columns, wanted, kept):
            if place is None:
                out.append({k: list(v) for k, v in column.items()})
                continue
            meet = self.columns[place]
            for key, (votes, words, head, tail) in column.items():
                form = meet.setdefault(key, [0, words, head, tail])
                form[0] += votes
            if anchor is not None:
                out += self.columns[at : place + 1]
                at = place + 1
        self.columns = out + self.columns[at:]

    def consensus(self) -> list[tuple[int, int]]:
        """(key, words) of the form with most votes of each column; of several the shortest, then the smallest key."""
        out = []
        for column in self.columns:
            key, form = min(column.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))
            if form[0] > 0:
                out.append((key, form[1]))
        return out

    def dump(self) -> str:
        return json.dumps([[[k, *v] for k, v in c.items()] for c in self.columns])

    @classmethod
    def load(cls, text: str) -> Profile:
        return cls([{k: v for k, *v in c} for c in json.loads(text)])


def _increasing(places: list[int | None]) -> list[int | None]:
    """``places`` with only a longest increasing run kept, the rest None."""
    tails: list[int] = []
    tail_at: list[int] = []
    before: list[int] = [-1] * len(places)
    for i, p in enumerate(places):
        if p is None:
            continue
        k = bisect_left(tails, p)
        before[i] = tail_at[k - 1] if k else -1
        if k == len(tails):
            tails.append(p)
            tail_at.append(i)
        else:
            tails[k], tail_at[k] = p, i
    keep = set()
    i = tail_at[-1] if tail_at else -1
    while i >= 0:
        keep.add(i)
        i = before[i]
    return [p if i in keep else None for i, p in enumerate(places)]


# -- tables -----------------------------------------------------------------------------------------------------

FEATURES = "id long, cluster_id long, head int, unit int, sound boolean, filled int, retrieved_us long, keys array<long>, marks array<struct<key:long,head:long,tail:long,words:int,sound:boolean>>"
PROFILES = "cluster_id long, n long, profile string"


def _features(dictionaries) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(dictionaries.value)
        for pdf in batches:
            rows = []
            for i, c, headline, body, filled, us in zip(*(pdf[x] for x in ("id", "cluster_id", "headline", "body_text", "filled", "retrieved_us"))):
                clustered = not pd.isna(c)
                broken, damaged, marks = False, frozenset(), []
                if clustered:
                    found = tokens(body)
                    keys = [f[0] for f in found]
                    broken = restorer.restore(body)[0]
                    if broken:  # sentences that are sound in themselves still vote
                        damaged = {k for raw in sentences(body) if restorer.restore(raw)[0] for k in token_keys(raw)}
                    broken = broken or restorer.restore(headline)[0]
                    marks = [(k, h, t, n, not cut and k not in damaged) for k, h, t, n, cut in found]
                else:
                    keys = token_keys(body)
                unit = _bit([f"c{int(c)}" if clustered else f"a{i}"])
                rows.append((i, int(c) if clustered else None, _bit(headline_words(headline)), unit, not broken, filled, us, keys, marks))
            yield pd.DataFrame(rows, columns=["id", "cluster_id", "head", "unit", "sound", "filled", "retrieved_us", "keys", "marks"]).astype({"cluster_id": "Int64"})

    return run


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One profile of each block's profiles, which come one after another, the largest first."""
    at, count, profile = None, 0, Profile()
    for pdf in batches:
        rows = []
        for c, block, n, text in zip(pdf["cluster_id"], pdf["block"], pdf["n"], pdf["profile"]):
            if (c, block) != at:
                if at is not None:
                    rows.append((at[0], count, profile.dump()))
                at, count, profile = (c, block), 0, Profile()
            count += int(n)
            profile.merge(Profile.load(text))
        yield pd.DataFrame(rows, columns=["cluster_id", "n", "profile"])
    if at is not None:
        yield pd.DataFrame([(at[0], count, profile.dump())], columns=["cluster_id", "n", "profile"])


def _own_profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A profile for each distinct text, with its number of copies as votes; damaged or cut tokens have none."""
    for pdf in batches:
        rows = []
        for c, n, marks in zip(pdf["cluster_id"], pdf["n"], pdf["marks"]):
            columns = [{int(m["key"]): [int(n), int(m["words"]), int(m["head"]), int(m["tail"])]} for m in marks if m["sound"]]
            rows.append((c, n, Profile(columns).dump()))
        yield pd.DataFrame(rows, columns=["cluster_id", "n", "profile"])


def _consensus(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([(c, [k for k, _ in Profile.load(p).consensus()]) for c, p in zip(pdf["cluster_id"], pdf["profile"])], columns=["cluster_id", "story"])


def group_consensus(features: DataFrame) -> DataFrame:
    """(cluster_id, story): the voted tokens of each group, in order.

    Equal texts are counted first, so that copies cost nothing; the distinct ones are aligned in blocks of
    ``BLOCK``, the blocks' profiles again, until one is left. No task sees more than one block of a group.
    """
    distinct = features.where("cluster_id is not null and size(marks) > 0").groupBy("cluster_id", "marks").agg(F.count("*").alias("n"))
    level = written(distinct.mapInPandas(_own_profile, PROFILES))
    while True:
        sizes = level.groupBy("cluster_id").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
        last = sizes.where("blocks > 1").isEmpty()
        salted = level.join(sizes, "cluster_id").select("cluster_id", F.pmod(F.xxhash64("profile"), F.col("blocks")).alias("block"), "n", "profile")
        # the number of tasks is set, as the bytes moved are too few for it to follow from them
        tasks = 4 * level.sparkSession.sparkContext.defaultParallelism
        ordered = salted.repartition(tasks, "cluster_id", "block").sortWithinPartitions("cluster_id", "block", F.desc(F.length("profile")), "profile")
        level = written(ordered.mapInPandas(_align, PROFILES))
        if last:
            return level.mapInPandas(_consensus, "cluster_id long, story array<long>")


def _story_marks(members: DataFrame, spread: DataFrame) -> DataFrame:
    """(id, cluster_id, marks): each member's sentences that belong to its group's story.

    A sentence in ``spread`` (key, n_all: all articles that hold it) belongs to it only if most members that have a
    sentence of their own hold it, and the group is no small part of all its holders. A group left with nothing
    keeps all its sentences, as a story copied far outside of it.
    """
    # a token's standing is looked up where it occurs in a group
    marked = (
        members.select("id", "cluster_id", F.posexplode("marks").alias("pos", "m")).select("id", "cluster_id", "pos", "m", F.col("m.key").alias("key"))
        .join(spread, "key", "left")
    )
    split = written(marked.groupBy("id", "cluster_id").agg(
        F.collect_list(F.when(F.col("n_all").isNull(), F.struct("pos", "m"))).alias("own"), F.collect_list(F.when(F.col("n_all").isNotNull(), F.struct("pos", "m", "n_all"))).alias("wide")
    ))
    groups = split.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.count_if(F.size("own") > 0).alias("n_own"))
    distinct = F.array_distinct(F.transform("wide", lambda w: F.struct(w["m"]["key"].alias("key"), w["n_all"].alias("n_all"))))
    held = split.select("cluster_id", F.explode(distinct).alias("w")).groupBy("cluster_id", F.col("w.key").alias("key")).agg(F.count("*").alias("n"), F.max("w.n_all").alias("n_all"))
    base = F.when(F.col("n_own") > 0, F.col("n_own")).otherwise(F.col("n_members"))
    # held by most members: no longer than two stories
    back = held.join(groups, "cluster_id").where((F.col("n") > HELD_SHARE * base) & (F.col("n") >= GROUP_SHARE * F.col("n_all"))).groupBy("cluster_id").agg(F.collect_list("key").alias("back"))
    known = split.join(groups.select("cluster_id", "n_own"), "cluster_id").join(back, "cluster_id", "left")
    bare = (F.col("n_own") == 0) & F.col("back").isNull()
    readmitted = F.transform(F.filter("wide", lambda w: bare | F.coalesce(F.array_contains("back", w["m"]["key"]), F.lit(False))), lambda w: F.struct(w["pos"].alias("pos"), w["m"].alias("m")))
    return known.select("id", "cluster_id", F.array_sort(F.concat("own", readmitted)).getField("m").alias("marks"))


def scored_members(articles: DataFrame) -> DataFrame:
    """Each member of a group: (cluster_id, article_id, whole, missing, extra, sound, filled, retrieved_us).

    ``missing`` and ``extra`` count the tokens that the member lacks of the consensus and has beyond it; ``sound``
    says whether all of it is readable. Sentences that stand under many headlines of the whole table are no
    story, unless most of the group holds them. Filled cells are counted without blanks and stand-ins for nothing. Rows without a group are only
    counted for the headlines. Texts that are null or empty lack everything.
    """
    dictionaries = articles.sparkSession.sparkContext.broadcast(train_dictionaries(articles))
    cells = [F.when(~F.coalesce(F.lower(F.trim(F.regexp_replace(c, "[\\u00a0\\u200b]", " "))), F.lit("")).isin(*NOTHING), 1).otherwise(0) for c in ("url", "byline", "language", "country")]
    wanted = articles.select("id", "cluster_id", "headline", "body_text", sum(cells[1:], cells[0]).alias("filled"), F.unix_micros(F.col("retrieved_at").cast("timestamp")).alias("retrieved_us"))
    features = written(wanted.where("id is not null").mapInPandas(_features(dictionaries), FEATURES))
    heads = features.select(F.explode(F.array_distinct("keys")).alias("key"), "head", "unit").groupBy("key").agg(
        F.bit_or(F.expr("shiftleft(1L, head)")).alias("heads"), F.bit_or(F.expr("shiftleft(1L, unit)")).alias("units"), F.count("*").alias("n_all")
    )
    spread = heads.where((F.bit_count("heads") >= FOREIGN_PLACES) & (F.bit_count("units") >= FOREIGN_PLACES)).select("key", "n_all")
    members = features.where("cluster_id is not null").drop("head", "unit")
    story_marks = written(_story_marks(members, spread))
    consensus = group_consensus(story_marks)
    scored = members.join(consensus, "cluster_id", "left")
    story = F.coalesce("story", F.array().cast("array<long>"))
    missing, extra = F.size(F.array_except(story, "keys")), F.size(F.array_except("keys", story))
    return scored.select(
        "cluster_id", F.col("id").alias("article_id"), missing.alias("missing"), extra.alias("extra"), "sound", "filled", "retrieved_us",
        ((missing == 0) & (extra == 0) & (F.size("keys") > 0) & F.col("sound")).alias("whole"), F.size("keys").alias("n_tokens"), F.size(story).alias("n_story"),
    )


def best_members(articles: DataFrame) -> DataFrame:
    """(cluster_id, article_id): of each group the member that is the whole story and nothing else, readable.

    Of several, the one with most cells filled, then the one retrieved last, then the smallest id. Where no member
    is whole, the one nearest to the consensus: readable members first by tokens lacking or beyond it. Every
    group gives one row.
    """
    members = scored_members(articles)
    empty = F.col("n_tokens") == 0
    away = F.col("missing") + F.col("extra") + F.when(F.col("sound"), 0).otherwise(F.greatest(F.col("n_story"), F.lit(1)))
    rank = F.struct(
        F.col("whole").cast("int"), (~empty).cast("int"), F.when(F.col("whole"), 0).otherwise(-away), "filled", F.coalesce("retrieved_us", F.lit(-(1 << 62))), (-F.col("article_id")).alias("last")
    )
    return members.groupBy("cluster_id").agg(F.max_by("article_id", rank).alias("article_id"))
