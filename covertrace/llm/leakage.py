"""Held-out test passages inside a corpus: shared-token seeds in a join, greedy string tiling, coverage of the test item."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.llm.fold import sentences, words
from covertrace.session import written

#: Tokens of a seed (of passages; of questions) that draws a document and an item together.
SEED, QUESTION_SEED = 4, 3
#: Share of an item's seeds (passage; question) a document must hold to be tiled; one altered word spoils at most half of
#: the seeds of a question of eight words.
SEED_SHARE, QUESTION_SHARE = 0.15, 0.35
#: Shortest tile, in tokens.
TILE = 3
#: Weight share of a sentence that nearby tiles must cover; share of the sentences; share of a question.
SENTENCE_COVER, PASSAGE_COVER, QUESTION_COVER = 0.55, 0.5, 0.85
#: Tokens by which tiles of one sentence may shift against each other, and within which an answer follows.
SHIFT, ANSWER_WITHIN = 4, 6
#: Bits of the table of seeds that goes to the executors: some for each seed, at most 32 MB however many items there are.
BITS_A_SEED, MOST_BITS = 32, 1 << 28
#: Most pairs whose documents are looked up by a broadcast; beyond, by a shuffle.
LOOKUP_BROADCAST = 200_000

LEAKS = "doc_id long, item_id long, sentence_share double, question_share double, with_answer boolean"
ITEMS = "item bigint, item_id bigint, passage array<bigint>, bounds array<int>, question array<bigint>, answer array<bigint>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 32_768  # bits of one row of Spark's bitmaps


class Tokens:
    """Words as 63-bit numbers; what a word gives is kept."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> list[int]:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > 1_000_000:
            known.clear()
        out = []
        for w in words(text):
            k = known.get(w)
            if k is None:
                k = known[w] = digest(w) >> 1
            out.append(k)
        return out


def running(tokens: list[int], size: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of ``size`` tokens."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ids = np.array(tokens, np.uint64)
    h = np.full(n, size, np.uint64)
    for e in range(size):
        h = h * _BASE + ids[e : e + n]
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def tile(p: list[int], d: list[int], p_runs: np.ndarray, d_runs: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of pattern ``p`` in ``d``: (start in p, start in d, length), longest first, none overlapping.

    Runs of ``least`` tokens meet by their running Karp-Rabin hashes and are then compared. The longest match is
    marked first; one that a mark cuts comes back with what is left of it.
    """
    places: dict[int, list[int]] = defaultdict(list)
    for j in np.flatnonzero(np.isin(d_runs, p_runs)).tolist():
        places[int(d_runs[j])].append(j)
    heap: list[tuple[int, int, int]] = []
    for i, run in enumerate(p_runs.tolist()):
        for j in places.get(run, ()):
            if (i and j and p[i - 1] == d[j - 1]) or p[i : i + least] != d[j : j + least]:
                continue
            n = least
            while i + n < len(p) and j + n < len(d) and p[i + n] == d[j + n]:
                n += 1
            heap.append((-n, i, j))
    heapq.heapify(heap)
    used_p, used_d, tiles = bytearray(len(p)), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        run, best, start = 0, [], 0
        for k in range(n + 1):
            if k < n and not used_p[i + k] and (j + k) not in used_d:
                start, run = (k, 1) if run == 0 else (start, run + 1)
            elif run:
                best.append((run, start))
                run = 0
        if best == [(n, 0)]:
            tiles.append((i, j, n))
            for k in range(n):
                used_p[i + k] = 1
                used_d.add(j + k)
        else:
            for run, start in best:
                if run >= least:
                    heapq.heappush(heap, (-run, i + start, j + start))
    return tiles


def covered(start: int, end: int, weights: list[float], tiles: list[tuple[int, int, int]]) -> float:
    """Weight share of tokens ``start`` to ``end`` covered by tiles that lie in the document as they do in the item."""
    parts = []
    for i, j, n in tiles:
        a, b = max(i, start), min(i + n, end)
        if a < b:
            parts.append((j - i, sum(weights[a:b])))
    parts.sort()
    best = total = 0.0
    first = 0
    for k, (offset, w) in enumerate(parts):
        total += w
        while offset - parts[first][0] > SHIFT:
            total -= parts[first][1]
            first += 1
        best = max(best, total)
    return best / (sum(weights[start:end]) or 1.0)


def _prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    take = Tokens()
    for pdf in batches:
        rows = []
        for item, i, passage, question, answer in zip(*(pdf[c] for c in ("item", "item_id", "passage", "question", "answer"))):
            run, bounds = [], [0]
            for s in sentences(passage):
                if ws := take.of(s):
                    run += ws
                    bounds.append(len(run))
            rows.append((item, i, run, bounds, take.of(question), take.of(answer)))
        yield pd.DataFrame(rows, columns=["item", "item_id", "passage", "bounds", "question", "answer"])


def prepared_items(items: DataFrame) -> DataFrame:
    """Items as tokens, with the bounds of their sentences and in ``weigh`` the number of sentences (of all) that hold each token."""
    keyed = items.where("item_id is not null").select(F.xxhash64("item_id", "passage", "question", "answer").alias("item"), "item_id", "passage", "question", "answer")
    read = written(keyed.dropDuplicates(["item"]).mapInPandas(_prepared, ITEMS))
    spans = F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda k: F.array_distinct(F.slice("passage", F.get("bounds", k - 1) + 1, F.get("bounds", k) - F.get("bounds", k - 1))))
    each = read.where("size(bounds) > 1").select("item", F.explode(spans).alias("ws")).select("item", F.explode("ws").alias("w"))
    df = each.groupBy("w").agg(F.count("*").alias("df"))
    weigh = each.distinct().join(df, "w").groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("w", "df"))).alias("weigh"))
    return read.join(weigh, "item", "left")


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for item, passage, question in zip(pdf["item"], pdf["passage"], pdf["question"]):
            for part, run, size in ((0, passage, SEED), (1, question, QUESTION_SEED)):
                found = np.unique(running(list(run), size))
                rows += [(seed, item, part, len(found)) for seed in found.tolist()]
        yield pd.DataFrame(rows, columns=["seed", "item", "part", "n_seeds"])


def seed_bits(seeds: DataFrame) -> np.ndarray:
    """A table of bits in which those of all seeds are set; its size is bounded, a seed that isn't there may seem to be."""
    n = seeds.count()
    size = _CHUNK
    while size < min(MOST_BITS, BITS_A_SEED * n):
        size *= 2
    at = F.pmod("seed", F.lit(size))
    chunks = seeds.select(F.floor(at / _CHUNK).cast("int").alias("k"), (at % _CHUNK).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).collect()
    bits = np.zeros((size // _CHUNK, _CHUNK // 8), np.uint8)
    for k, b in chunks:
        bits[k] = np.frombuffer(bytes(b), np.uint8)
    return bits.reshape(-1)


def candidate_pairs(documents: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc, item) of the documents (doc, text) that hold the stated share of an item's seeds.

    The corpus is read once, whatever the number of items: a document emits those of its seeds whose bit is set, which
    are joined with the items' seeds.
    """
    sent = documents.sparkSession.sparkContext.broadcast(seed_bits(seeds))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take, bits = Tokens(), sent.value
        mask = len(bits) * 8 - 1
        for pdf in batches:
            docs, found = [], []
            for doc, text in zip(pdf["doc"], pdf["text"]):
                tokens = take.of(text)
                for size in (SEED, QUESTION_SEED):
                    h = running(tokens, size)
                    at = h & mask
                    own = np.unique(h[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1])
                    if len(own):
                        found.append(own)
                        docs.append(np.full(len(own), doc, np.int64))
            yield pd.DataFrame({"doc": np.concatenate(docs) if docs else np.zeros(0, np.int64), "seed": np.concatenate(found) if found else np.zeros(0, np.int64)})

    met = documents.select("doc", "text").mapInPandas(emit, "doc long, seed long").join(seeds, "seed")
    # a document that stands twice has its seeds twice
    held = met.groupBy("doc", "item", "part").agg(F.size(F.collect_set("seed")).alias("n"), F.max("n_seeds").alias("n_seeds"))
    share = F.col("n") / F.col("n_seeds")
    return held.where(share >= F.when(F.col("part") == 0, SEED_SHARE).otherwise(QUESTION_SHARE)).select("doc", "item").distinct()


def _tiled(n_sentences: int):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take, at, tokens, runs = Tokens(), None, [], np.zeros(0, np.int64)
        for pdf in batches:
            rows = []
            for doc, doc_id, text, item_id, passage, bounds, question, answer, weigh in zip(*(pdf[c] for c in ("doc", "doc_id", "text", "item_id", "passage", "bounds", "question", "answer", "weigh"))):
                if doc != at:
                    at, tokens = doc, take.of(text)
                    runs = running(tokens, TILE)
                passage, question, answer = [list(x) for x in (passage, question, answer)]
                df = dict(weigh) if weigh is not None else {}
                weights = [math.log(1 + n_sentences / df[t]) for t in passage]
                tiles = tile(passage, tokens, running(passage, TILE), runs)
                n = sum(covered(a, b, weights, tiles) >= SENTENCE_COVER for a, b in zip(bounds, bounds[1:]))
                asked = tile(question, tokens, running(question, TILE), runs)
                share = covered(0, len(question), [1.0] * len(question), asked) if question else 0.0
                follows = False
                if share >= QUESTION_COVER and answer:
                    end, m = max(j + n for _, j, n in asked), len(answer)
                    follows = any(tokens[e : e + m] == answer for e in range(end, end + ANSWER_WITHIN + 1))
                rows.append((doc_id, item_id, n / max(1, len(bounds) - 1), share, follows))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "sentence_share", "question_share", "with_answer"])

    return check


def leak_scores(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, sentence_share, question_share, with_answer) of every pair that shares enough seeds.

    Items stand in a table and meet documents by a join on hashed seeds; the corpus is tokenised once, whole texts, for
    any number of items and words. Pairs that share enough are tiled. Items are compared folded (case, marks, tags,
    quoting marks, digit grouping). Null or empty texts share nothing; null parts of an item count as absent, items
    without an id aren't looked for; a question of under three words, or a passage of under four, is too few
    words in common to count. Repeated documents come out as often as they stand, repeated items once.
    """
    prepared = written(prepared_items(items))
    seeds = written(prepared.mapInPandas(_item_seeds, "seed long, item long, part int, n_seeds int"))
    keyed = documents.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")
    pairs = written(candidate_pairs(keyed, seeds))
    few = pairs.count() <= LOOKUP_BROADCAST
    total = prepared.agg(F.coalesce(F.sum(F.size("bounds") - 1), F.lit(0))).first()[0]
    met = keyed.join(F.broadcast(pairs) if few else pairs, "doc")
    return met.join(prepared, "item").sortWithinPartitions("doc", "item").mapInPandas(_tiled(total), LEAKS)


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document has at least half of the passage's sentences, or the question with its answer."""
    scores = leak_scores(documents, items)
    return scores.where((F.col("sentence_share") >= PASSAGE_COVER) | ((F.col("question_share") >= QUESTION_COVER) & F.col("with_answer"))).select("doc_id", "item_id")
