"""New batches against all accepted history: a stored inverted index of rare tokens, probed, verified and appended to."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from covertrace.llm.anchors import anchors_of, skeleton
from covertrace.operators.components import smallest_linked
from covertrace.session import discard, removed_at_exit, shared_folder, shuffles_removed, written

#: Different texts (classes of copies, told apart by their words) under one token, beyond which it is a standing phrase
#: and by itself no sign of one text.
CLASSES = 8
#: Share of the larger text's tokens that makes a pair a candidate where the tokens in common are standing phrases.
STANDING_SHARE = 0.5
#: A text of at most so many tokens that stands under several headlines, and mostly doesn't speak of them, is a notice.
NOTICE_TOKENS = 4
#: Share of the smaller text's tokens that makes a pair a candidate, and that with ``SURE_TOKENS`` tokens settles it.
CANDIDATE_SHARE, SURE_SHARE, SURE_TOKENS = 0.2, 0.7, 6
#: Share of the smaller text's word runs that two versions of a text have in common; the same where they share but one token.
SAME_SHARE, LONE_SHARE, WORD_RUN = 0.5, 0.8, 3
#: Most texts that are looked up by broadcasting their ids; beyond, they are joined by a shuffle.
LOOKUP_BROADCAST = 200_000
#: Letters, at least, of the two words in a row that a text shares with the headline it speaks of.
SPOKEN_LETTERS = 6
#: Buckets of a stored index.
BUCKETS = 32

TEXTS = "id long, whole string, n int, head long, spoken int, toks array<long>"
TOKEN_ROWS, ROOT_ROWS = "tok long, id long, n int, beyond boolean", "id long, root long"
WHOLE_ROWS = "whole string, id long, root long, n int, copies long, head_low long, head_high long, spoken long"
_PARTS = re.compile(r"\s[-–—|:]\s")


def headline_words(headline: str | None) -> list[str]:
    """The words of a headline's comparison form: its longest part, without an outlet's name or a rubric beside it, and without marks."""
    part = max(_PARTS.split(headline or ""), key=len)
    return [w for w in (p.strip(".!?") for p in skeleton(part).split()) if w]


def speaks_of(form: str, words: list[str]) -> bool:
    """Whether a text's skeleton has two words in a row of its headline, as a story mostly does and a notice doesn't."""
    runs = [f"{a} {b}" for a, b in zip(words, words[1:]) if len(a) + len(b) >= SPOKEN_LETTERS]
    if not runs:
        return False
    text = " ".join(form.split())
    return any(r in text for r in runs)


def _whole(body: str, form: str) -> str:
    """Digest of a text's whole skeleton without marks; of a text that has none (other scripts), of its words."""
    ws = [w for w in (p.strip(".!?") for p in form.split()) if w] or body.casefold().split()
    return xxhash.xxh3_128_hexdigest(" ".join(ws)) if ws else ""


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, headline, body in zip(pdf["id"], pdf["headline"], pdf["body_text"]):
            form = skeleton(body)
            whole = _whole(body or "", form)
            if whole:
                words = headline_words(headline)
                toks = anchors_of(form)
                rows.append((i, whole, len(toks), xxhash.xxh3_64_intdigest(" ".join(words)) >> 1, int(speaks_of(form, words)), toks))
        yield pd.DataFrame(rows, columns=["id", "whole", "n", "head", "spoken", "toks"])


def read_texts(batch: DataFrame) -> DataFrame:
    """One row for each text with words: digest of the whole, tokens, hash of the headline, whether the text speaks of it.

    This is the one step that tokenises; it is given a batch, never the history.
    """
    return batch.select("id", "headline", "body_text").where(F.col("id").isNotNull() & F.col("body_text").isNotNull()).mapInPandas(_read, TEXTS)


@F.pandas_udf(T.BinaryType())
def packed_words(text: pd.Series) -> pd.Series:
    """The words of a text's skeleton without marks, compressed: what ``run_share`` compares, in a third of the text's bytes."""
    pack = zstandard.ZstdCompressor().compress
    return pd.Series([pack(" ".join(x for x in (p.strip(".!?…") for p in skeleton(t).split()) if x).encode()) for t in text], dtype="object")


def _share(a: bytes, b: bytes) -> float:
    runs = []
    for words in (a, b):
        w = zstandard.decompress(words).decode().split()
        runs.append(set(zip(*[w[k:] for k in range(WORD_RUN)])))
    small = min(len(runs[0]), len(runs[1]))
    return len(runs[0] & runs[1]) / small if small else 0.0


@F.pandas_udf(T.DoubleType())
def run_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the smaller text's runs of ``WORD_RUN`` words that stand in the other, of texts by ``packed_words``."""
    return pd.Series([_share(x, y) for x, y in zip(a, b)], dtype="float64")


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(id, other) of the pairs that are one text: settled by their tokens, or else by the word runs of the two texts.

    Of ``bodies`` only those of open pairs are looked up; their ids are broadcast only if few enough. Each text is
    moved as packed words, and only to the end of a pair where it stands.
    """
    pairs = written(pairs)
    sure = (F.col("share") >= SURE_SHARE) & (F.col("shared") >= SURE_TOKENS)
    settled, open_pairs = pairs.where(sure).select("id", "other"), pairs.where(~sure)
    ends = open_pairs.select(F.explode(F.array(F.struct("id", F.lit(True).alias("new")), F.struct(F.col("other").alias("id"), F.lit(False).alias("new")))).alias("e")).select("e.*")
    ids = ends.groupBy("id").agg(F.max("new").alias("as_new"), (~F.min("new")).alias("as_other"))
    n = ids.limit(LOOKUP_BROADCAST + 1).count()
    if not n:
        return settled
    held = written(bodies.join(F.broadcast(ids) if n <= LOOKUP_BROADCAST else ids, "id").select("id", "as_new", "as_other", packed_words("body_text").alias("words")))
    a = held.where("as_new").select("id", F.col("words").alias("a"))
    b = held.where("as_other").select(F.col("id").alias("other"), F.col("words").alias("b"))
    same = run_share("a", "b") >= F.when(F.col("shared") > 1, SAME_SHARE).otherwise(LONE_SHARE)
    out = written(settled.unionByName(open_pairs.join(a, "id").join(b, "other").where(same).select("id", "other")))
    discard(pairs, held)
    return out


def _counted(met: DataFrame) -> DataFrame:
    """(id, other, shared, n, other_n): the pairs in ``met`` (id, n, other, other_n) with the tokens they have in common."""
    # placed by the new text alone, so that what belongs to it joins without moving the pairs again
    return met.repartition("id").groupBy("id", "other").agg(F.count("*").alias("shared"), F.max("n").alias("n"), F.max("other_n").alias("other_n"))


def _candidates(pairs: DataFrame, standing: DataFrame | None = None) -> DataFrame:
    """(id, other, shared, share) of the pairs with enough tokens in common, by the length of the smaller text.

    Standing phrases of the new text don't count for its length.
    """
    own = F.col("n")
    if standing is not None:
        pairs, own = pairs.join(standing, "id", "left"), F.col("n") - F.coalesce("n_standing", F.lit(0))
    small = F.greatest(F.least(own, F.col("other_n")), F.lit(1))
    return pairs.select("id", "other", "shared", (F.col("shared") / small).alias("share")).where(F.col("share") >= CANDIDATE_SHARE)


class TextIndex:
    """A stored index of accepted texts in four tables: tokens (bucketed by token), whole texts, the class of each text that has one with others, joined classes.

    A token's rows are the first texts of all classes that hold it; those of a standing phrase beyond the first
    ``CLASSES`` + 1 are marked so. ``accept`` reads the batch, the index rows of the batch's own tokens and the
    bodies of candidates; nothing else of the history. Batches are appended, no row is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets or BUCKETS
        mark = uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        self.tokens_name, self.wholes_name, self.roots_name, self.aliases_name = (f"covertrace_{kind}_{mark}" for kind in ("tokens", "wholes", "roots", "aliases"))
        for name, columns, key in ((self.tokens_name, TOKEN_ROWS, "tok"), (self.wholes_name, WHOLE_ROWS, "whole"), (self.roots_name, ROOT_ROWS, "id")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.aliases_name} (id long, root long) USING parquet LOCATION '{self.path}/{self.aliases_name}'")

    @classmethod
    def temporary(cls, spark: SparkSession) -> TextIndex:
        """An empty index in the shared folder, removed at the session's end."""
        path = f"{shared_folder(spark)}/covertrace-index-{uuid.uuid4().hex}"
        removed_at_exit(spark, path)
        return cls(spark, path)

    def tokens(self) -> DataFrame:
        """Tokens with the first texts of their classes, of standing phrases only as many as show them to be so."""
        return self.spark.table(self.tokens_name).where("NOT beyond").drop("beyond")

    def wholes(self) -> DataFrame:
        """Each whole text with its first id, its copies, the bounds of their headlines' hashes and how many speak of them."""
        return self.spark.table(self.wholes_name).groupBy("whole").agg(
            F.min("id").alias("first"), F.min("root").alias("root"), F.first("n").alias("n"), F.sum("copies").alias("copies"), F.min("head_low").alias("head_low"), F.max("head_high").alias("head_high"), F.sum("spoken").alias("spoken")
        )

    def accept(self, batch: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(id, root): each text of ``batch`` that repeats an earlier one, with the first of its kind; the batch is then part of the index.

        ``history`` holds the accepted articles, whose bodies are looked up by id where a candidate's words are to be compared.
        Equal texts meet by their digest. Others meet, for each of their tokens, first the earliest text
        that holds it, then the first text of every class that holds it. Pairs with a fifth of the smaller text's
        tokens in common are candidates; near-certain ones stand, others are verified by their word runs. Tokens of more than ``CLASSES``
        classes, verified to differ, are standing phrases: they don't count in this, but texts with half of the larger one's
        tokens in common, of whatever kind, are candidates too, and verified as pairs with one token are (``_alike``). Links are
        then drawn together. What a step has written or shuffled is removed once the next ones don't read it.

        Texts that are null or empty repeat nothing, nor do notices: texts of at most ``NOTICE_TOKENS`` tokens under
        different headlines of which most copies don't speak. Repeated ids count as one text; extra columns are ignored.
        """
        with shuffles_removed(self.spark):
            return self._accepted(batch, history)

    def _accepted(self, batch: DataFrame, history: DataFrame | None) -> DataFrame:
        own = batch.select("id", "headline", "body_text")
        bodies = (own if history is None else own.unionByName(history.select("id", "headline", "body_text"))).select("id", "body_text")
        read = written(read_texts(own))
        # copies of one text: one row a digest, over the index and the batch
        new_wholes = read.groupBy("whole").agg(
            F.min(F.struct("id", "n", "toks")).alias("f"), F.count("*").alias("copies"), F.min("head").alias("head_low"), F.max("head").alias("head_high"), F.sum("spoken").cast("long").alias("spoken")
        ).select("whole", "f.*", "copies", "head_low", "head_high", "spoken")
        known = self.wholes().select("whole", "first", "root", F.col("copies").alias("c"), F.col("head_low").alias("lo"), F.col("head_high").alias("hi"), F.col("spoken").alias("s"))
        met = written(new_wholes.join(known, "whole", "left"))
        heads = (F.least("head_low", "lo"), F.greatest("head_high", "hi"))
        copies, spoken = F.col("copies") + F.coalesce("c", F.lit(0)), F.col("spoken") + F.coalesce("s", F.lit(0))
        notice = (F.col("n") <= NOTICE_TOKENS) & (heads[0] < heads[1]) & (2 * spoken < copies)
        kept = met.where(~notice)
        leads = kept.where("copies > 1 OR first IS NOT NULL").select("whole", F.least("id", "root").alias("lead"))
        links = [written(read.select("id", "whole").join(leads, "whole").where("id <> lead").select("id", F.col("lead").alias("other")))]
        ids = written(read.select("id"))
        discard(read)
        # distinct texts that the index doesn't have yet
        fresh = kept.where("first IS NULL").select("id", "n", "toks")
        single = None
        if not fresh.groupBy("id").count().where("count > 1").isEmpty():
            fresh = single = written(fresh.dropDuplicates(["id"]))
        held = stored = None
        if not self.spark.table(self.tokens_name).isEmpty():
            toks = fresh.select(F.explode("toks").alias("tok"))
            met_rows = self.spark.table(self.tokens_name).drop("beyond").join(toks, "tok", "left_semi")
            held = written(met_rows.withColumn("earliest", F.row_number().over(W.partitionBy("tok").orderBy("id")) == 1))
            roots = self.spark.table(self.roots_name).groupBy("id").agg(F.min("root").alias("root"))
            stored = written(held.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))
        wholes = written(met.drop("toks"))
        more, placed = self._linked(fresh, held, stored, bodies, self.buckets)
        discard(met, single, held)
        links += more
        every = self._all(links)
        # the classes of stored texts that were met, and those drawn together since
        if held is not None:
            every = every.unionByName(self._stored(stored, every)).unionByName(self.spark.table(self.aliases_name).select("id", F.col("root").alias("other")))
        roots = smallest_linked(every, "id", "other")
        self._append(wholes, placed, stored, roots)
        discard(wholes, placed, stored)
        return roots.join(ids, "id", "left_semi").where("root <> id")

    @staticmethod
    def _all(links: list[DataFrame]) -> DataFrame:
        out = links[0]
        for more in links[1:]:
            out = out.unionByName(more)
        return out

    @staticmethod
    def _stored(stored: DataFrame, links: DataFrame) -> DataFrame:
        """(id, other): the stored texts that ``links`` lead to, each with its class."""
        return stored.where("id <> root").join(links.select(F.col("other").alias("id")).distinct(), "id", "left_semi").select("id", F.col("root").alias("other"))

    @staticmethod
    def _linked(fresh: DataFrame, held: DataFrame | None, stored: DataFrame | None, bodies: DataFrame, buckets: int) -> tuple[list[DataFrame], DataFrame]:
        """Two rounds of links: with the earliest text of each token, then with the first text of each class under it.

        Also the tokens' rows by class (tok, id, n, cls, mine, first, new, beyond, standing, heads), without those that
        the first of their class stands for where a token has but one; each of its files holds tokens of one bucket.
        """
        whole = (W.unboundedPreceding, W.unboundedFollowing)
        posted = fresh.select(F.explode("toks").alias("tok"), "id", "n", F.lit(True).alias("mine"))
        rows = posted if held is None else posted.unionByName(held.where("earliest").select("tok", "id", "n", F.lit(False).alias("mine")))
        earliest = W.partitionBy("tok").orderBy("id").rowsBetween(*whole)
        star = rows.select("id", "n", "mine", F.first("id").over(earliest).alias("other"), F.first("n").over(earliest).alias("other_n")).where("mine AND id <> other")
        links = _verified(_candidates(_counted(star)), bodies)
        labels = smallest_linked(links if held is None else links.unionByName(TextIndex._stored(stored, links)), "id", "other")
        label_of = lambda key: labels.select(F.col("id").alias(key), F.col("root").alias("cls"))
        # the class is joined to whole texts, and their tokens are moved once
        rows = fresh.join(label_of("id"), "id", "left").select(F.explode("toks").alias("tok"), "id", "n", F.coalesce("cls", "id").alias("cls"), F.lit(True).alias("mine"))
        if held is not None:
            classes = stored.join(label_of("root"), "root", "left").select("id", F.coalesce("cls", "root").alias("cls"))
            rows = rows.unionByName(held.join(classes, "id").select("tok", "id", "n", "cls", F.lit(False).alias("mine")))
        in_class, under = W.partitionBy("tok", "cls").orderBy("id"), W.partitionBy("tok").orderBy("cls", "id")  # one order, so one sort
        # as many parts as are wanted, in a multiple of the buckets: a part then lies within one bucket, and its rows are appended where they are
        parts = buckets * -(-int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
        several = "first AND classes BETWEEN 2 AND " + str(CLASSES)
        placed = (
            rows.repartition(parts, "tok")
            .select("*", (F.row_number().over(in_class) == 1).alias("first"), F.count(F.expr("IF(mine, NULL, 1)")).over(in_class.rowsBetween(*whole)).alias("had"))
            .withColumn("new", F.expr("first AND had = 0"))
            .select(
                "*",
                F.count(F.expr("IF(first, 1, NULL)")).over(under.rowsBetween(*whole)).alias("classes"),
                (F.count(F.expr("IF(mine, NULL, 1)")).over(under.rowsBetween(*whole)) + F.count(F.expr("IF(new, 1, NULL)")).over(under.rowsBetween(W.unboundedPreceding, 0))).alias("place"),
            )
            .where("first OR (mine AND classes > 1)")
            .withColumn("heads", F.collect_list(F.expr(f"IF({several}, struct(cls AS other_cls, id AS other, n AS other_n), NULL)")).over(under.rowsBetween(*whole)))
            .select("tok", "id", "n", "cls", "mine", "first", "new", (F.col("place") > CLASSES + 1).alias("beyond"), (F.col("classes") > CLASSES).alias("standing"), F.expr("IF(mine, heads, NULL)").alias("heads"))
        )
        placed = written(placed)
        pairs = placed.where("size(heads) > 0").select("id", "n", "cls", F.explode("heads").alias("h")).select("id", "n", "cls", "h.*").where("cls <> other_cls")
        texts, rare, alike = TextIndex._alike(placed.where("standing"))
        candidates = _candidates(_counted(pairs), texts.where("n_standing > 0").select("id", "n_standing"))
        more = _verified(candidates if alike is None else candidates.unionByName(alike), bodies)
        discard(texts, rare)
        return [links, more], placed

    @staticmethod
    def _alike(hot: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Of the rows of standing phrases: the texts under them (id, n_standing, ...), their rarest tokens, and the candidates (id, other, shared, share) by these.

        A pair has ``STANDING_SHARE`` of the larger text's tokens in common, so both texts consist of standing
        phrases by as much, and they meet in one that is among the rarest of both: of m, all but the most frequent,
        fewer than the tokens needed. No pair is missed by this, whatever the number of texts under a token.
        """
        needed = F.ceil(F.col("n") * STANDING_SHARE)
        # a text's rows are moved once; its class only where it isn't the text itself
        moved = hot.select("tok", "id", "n", F.expr("NULLIF(cls, id)").alias("cls"), "mine", "first").repartition("id")
        texts = moved.groupBy("id").agg(F.max("n").alias("n"), F.coalesce(F.min("cls"), "id").alias("cls"), *[F.collect_list(F.expr(f"IF({kind}, tok, NULL)")).alias(kind) for kind in ("mine", "first")])
        texts = written(texts.select("id", "n", "cls", F.size("mine").alias("n_standing"), *[F.when(F.size(kind) >= needed, F.col(kind)).alias(kind) for kind in ("mine", "first")]))
        if texts.where("mine IS NOT NULL").isEmpty():
            return texts, None, None
        # in the batch's texts and in the first ones of their classes (most texts of a batch are both) the rarest tokens, by the latter
        rows = texts.select(F.explode(F.array_union(*[F.coalesce(kind, F.array().cast("array<bigint>")) for kind in ("mine", "first")])).alias("tok"), "*")
        rows = rows.select("tok", "id", "n", "cls", *[F.expr(f"IF(array_contains({kind}, tok), 1, 0)").alias(kind) for kind in ("mine", "first")])
        rows = rows.withColumn("often", F.sum("first").over(W.partitionBy("tok"))).where("often > 0")
        text = W.partitionBy("id").orderBy("often", "tok")
        for kind in ("mine", "first"):
            k, m = F.sum(kind).over(text.rowsBetween(W.unboundedPreceding, 0)), F.sum(kind).over(text.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            rows = rows.withColumn(f"k_{kind}", k).withColumn(f"m_{kind}", m)
        is_rare = {kind: (F.col(kind) == 1) & (F.col(f"k_{kind}") <= F.col(f"m_{kind}") - needed + 1) for kind in ("mine", "first")}
        rare = written(rows.where(is_rare["mine"] | is_rare["first"]).select("tok", "id", "n", "cls", "m_mine", "m_first", *[rare.alias(kind) for kind, rare in is_rare.items()]))
        new = rare.where("mine").select("tok", "id", "n", "cls", F.col("m_mine").alias("m"))
        known = rare.where("first").select("tok", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("cls").alias("other_cls"), F.col("m_first").alias("other_m"))
        wanted = F.greatest("n", "other_n") * STANDING_SHARE
        met = new.join(known, "tok").where("cls <> other_cls").where(F.least("m", "other_m") >= wanted).select("id", "n", "other", "other_n")
        pairs = met.repartition("id").distinct().join(texts.where("mine IS NOT NULL").select("id", F.col("mine").alias("a")), "id")
        pairs = pairs.join(texts.where("first IS NOT NULL").select(F.col("id").alias("other"), F.col("first").alias("b")), "other").where(F.size(F.array_intersect("a", "b")) >= wanted)
        return texts, rare, pairs.select("id", "other", F.lit(0).cast("long").alias("shared"), F.lit(0.0).alias("share"))

    def _append(self, wholes: DataFrame, placed: DataFrame, stored: DataFrame | None, roots: DataFrame) -> None:
        # the first text of each class that a token didn't have
        placed.where("new").select("tok", "id", "n", "beyond").write.insertInto(self.tokens_name)
        rooted = wholes.drop("root").join(roots, "id", "left").withColumn("root", F.least("id", "root"))
        rooted.select("whole", "id", "root", "n", "copies", "head_low", "head_high", "spoken").repartition(self.buckets, "whole").write.insertInto(self.wholes_name)
        roots.where("root <> id").repartition(self.buckets, "id").write.insertInto(self.roots_name)
        if stored is not None:  # classes of the index that the batch has drawn together
            joined = roots.join(stored.select(F.col("root").alias("id")).distinct(), "id", "left_semi").where("root <> id")
            joined.select("id", "root").write.insertInto(self.aliases_name)
        for name in (self.tokens_name, self.wholes_name, self.roots_name, self.aliases_name):
            self.spark.catalog.refreshTable(name)


def skipped_duplicates(accepted: DataFrame, incoming: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """(accepted_id, incoming_id): each incoming article whose text was accepted before, with the first article that has it.

    ``index`` is a stored index of ``accepted``; without one, ``accepted`` is taken into a new one first.
    """
    if index is None:
        index = TextIndex.temporary(accepted.sparkSession)
        index.accept(accepted)
    found = index.accept(incoming, accepted)
    return found.where("root < id").select(F.col("root").alias("accepted_id"), F.col("id").alias("incoming_id"))
