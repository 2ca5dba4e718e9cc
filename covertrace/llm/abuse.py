"""Abusive, hateful or sexual content: averaged subword bags under a linear softmax, trained in numpy, scored by sentence."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.llm.fold import fold

#: Most documents voted harmless, and voted abusive, that the classifier is fitted on, chosen by a hash of their id.
LABELLED_DOCUMENTS = (4_500, 1_500)
#: Hash buckets of features, size of their vectors, lengths of character n-grams.
BUCKETS, DIMENSIONS, NGRAMS = 1 << 17, 12, (3, 4, 5)
#: Features of no weight that each average has besides its own, so that a word or two alone don't decide.
PRIOR = 12
#: Rounds of choosing sentences and fitting; passes of each; size of a step; sentences in a batch; steps of a round, at least.
ROUNDS, PASSES, STEP, BATCH, LEAST_STEPS = 6, 2, 0.6, 512, 12
#: Rounds in which all votes are believed; documents voted abusive by which a feature's evidence is halved.
TRUSTING, RARE = 2, 3
#: Log-odds of every sentence where nothing was learned.
NOTHING_KNOWN = -10.0
#: Sentences of a harmless document that a round takes besides its most suspicious one, and as many short ones, of at
#: most so many features (a name, a number, a broken line).
OTHERS, SHORT = 3, 30
#: Score from which a document counts.
THRESHOLD = 0.2
#: A vote for abuse is left out where the model gives its document less than the first, one against where it gives more than the second.
TRUST = (0.1, 0.9)
SEED = 7

_SPEAKER = re.compile(r"^\s*[A-Za-z_][A-Za-z0-9_]{1,30}:\s+", re.M)
_QUOTE_LINES = re.compile(r"\n[ \t]*>[ \t]*")
_WRAPPED = re.compile(r"\n(?=[a-zß-öø-ÿ])(?:(?<=[a-zß-öø-ÿ,]\n)|(?<=[a-zß-öø-ÿ,][ \t]\n))")
_PARTS = re.compile(r"[.!?…]+[\"”»“«’')\]]*\s+|\n+")
_SPACED = re.compile(r"(?<![a-z0-9])(?:[a-z][.\-_*· ]){2,}[a-z](?![a-z0-9])")
_LEET = str.maketrans("013457@$!€", "oieastasie")
_LEET_WORD = re.compile(r"(?<![\d.,])(?=[\d@$!€]*[a-z])[a-z@$!€\d]*[@$!€\d][a-z@$!€\d]*[a-z][a-z@$!€\d]*|(?<![^\W])[a-z]+[@$!€013457]+[a-z]+")
_LEET_SEEN = re.compile(r"[@$!€013457](?=[a-z])")
_REPEATED = re.compile(r"([a-z])\1{2,}")
_TRIPLES = tuple(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(r"[a-z]+|\d+|[^\W\d_]+")
_MASKED = re.compile(r"[a-z]+(?:\*+[a-z]*)*|\d+|[^\W\d_]+")


def segments(text: str | None) -> list[str]:
    """Folded sentences and lines of a text, whole.

    Speakers' names and quoting marks are left out, wrapped lines joined, spaced letters joined, look-alike digits
    within words read as letters, drawn-out letters shortened.
    """
    if not text:
        return []
    if "\n" in text:
        if "\n>" in text:
            text = _QUOTE_LINES.sub(" ", text)
        text = _WRAPPED.sub(" ", _SPEAKER.sub("", text))
    s = fold(text)
    if _SPACED.search(s):
        s = _SPACED.sub(lambda m: re.sub(r"[^a-z]", "", m[0]), s)
    if _LEET_SEEN.search(s):
        s = _LEET_WORD.sub(lambda m: m[0].translate(_LEET), s)
    if any(t in s for t in _TRIPLES):
        s = _REPEATED.sub(r"\1", s)
    return [x for x in _PARTS.split(s) if x]


def tokens(segment: str) -> list[str]:
    """Words of a folded sentence; numbers as 0."""
    return ["0" if t[0] <= "9" else t for t in (_MASKED if "*" in segment else _TOKEN).findall(segment)]


def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a word and its character n-grams; a masked word also has one for being masked."""
    out = [_bucket("w:" + word)]
    if "*" in word:
        out.append(_bucket("masked"))
    if len(word) > 2:
        marked = f"<{word}>"
        for n in NGRAMS:
            out += [_bucket(marked[i : i + n]) for i in range(len(marked) - n + 1)]
    return out


def pair_buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the words' own."""
    return ((first * 1_000_003) ^ (second * 7_919 + 13)) % BUCKETS


class Featurizer:
    """Words to features; what a word gives is kept."""

    def __init__(self) -> None:
        self.known: dict[str, np.ndarray] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        parts = []
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = np.array(word_features(w), np.int64)
            parts.append(f)
        if len(parts) > 1:
            own = np.array([f[0] for f in parts])
            parts.append(pair_buckets(own[:-1], own[1:]))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Model:
    """Feature vectors and a softmax over their average, for two classes."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors, self.weights, self.bias = vectors, weights, bias

    @classmethod
    def fresh(cls) -> Model:
        rng = np.random.default_rng(SEED)
        return cls(rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS, rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2))

    def values(self) -> tuple[np.ndarray, float]:
        """The model as one number per feature and an offset: the log-odds of a sentence are their average (with the prior) plus the offset."""
        w = self.weights[:, 1] - self.weights[:, 0]
        return self.vectors @ w, float(self.bias[1] - self.bias[0])

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, passes: int, rng: np.random.Generator, weights: np.ndarray) -> None:
        """Joint steps (Adagrad) on vectors and softmax over shuffled batches."""
        if not hasattr(self, "seen"):
            self.seen = (np.full((BUCKETS, 1), 1e-2), np.full((DIMENSIONS, 2), 1e-2), np.full(2, 1e-2))
        for _ in range(passes):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                lengths = np.array([len(bags[i]) for i in chosen])
                weigh = (lengths + PRIOR)[:, None]
                index = np.concatenate([bags[i] for i in chosen])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                mean = np.add.reduceat(self.vectors[index], starts, axis=0) / weigh
                z = mean @ self.weights + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(chosen)), labels[chosen]] -= 1
                p *= weights[chosen][:, None]
                g_mean = (p @ self.weights.T) / weigh
                g_w, g_b = mean.T @ p / len(chosen), p.mean(0)
                place, rows = pd.factorize(index)
                each = np.repeat(g_mean, lengths, axis=0)
                g = np.stack([np.bincount(place, each[:, k], len(rows)) for k in range(DIMENSIONS)], 1)
                self.seen[0][rows] += (g * g).mean(1, keepdims=True)
                self.vectors[rows] -= STEP * g / np.sqrt(self.seen[0][rows])
                for value, grad, seen in ((self.weights, g_w, self.seen[1]), (self.bias, g_b, self.seen[2])):
                    seen += grad * grad
                    value -= 0.2 * STEP * grad / np.sqrt(seen)


def evidence(bags: list[list[np.ndarray]], labels: list[int]) -> np.ndarray:
    """How much more often each feature stands in documents voted abusive than in others (log-odds, drawn to 0 where it is rare)."""
    seen = np.zeros((2, BUCKETS))
    for own, y in zip(bags, labels):
        if own:
            seen[y, np.unique(np.concatenate(own))] += 1
    n = np.array([labels.count(0), labels.count(1)], float)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return odds * (seen[1] / (seen[1] + RARE))


def train(documents: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Feature values and offset from (text, label) pairs, labels standing for whole documents; nothing else is known at the start.

    A document counts by its most suspicious sentence, at first the one with most evidence among the votes: each round scores all sentences with the model so far, takes
    that sentence of an abusive document as abusive, and of a harmless one, with some others, as harmless; then
    fits. Votes that the model clearly contradicts are left out, as they may be wrong. Without votes of both kinds
    nothing is suspicious.
    """
    rng = np.random.default_rng(SEED)
    make = Featurizer()
    labels_of = [y for _, y in documents]
    if not 0 < sum(labels_of) < len(labels_of) or not any(segments(text) for text, _ in documents):
        return np.zeros(BUCKETS), NOTHING_KNOWN
    bags: list[list[np.ndarray]] = [[f for s in segments(text) if len(f := make.of(tokens(s)))] for text, _ in documents]
    flat = [f for own in bags for f in own]
    lengths = np.array([len(f) for f in flat])
    index, starts = np.concatenate(flat), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ends = np.cumsum([len(own) for own in bags])
    value, offset = evidence(bags, labels_of), 0.0
    model = Model.fresh()
    for k in range(ROUNDS):
        chosen: list[np.ndarray] = []
        labels: list[int] = []
        scale: list[float] = []
        every = np.add.reduceat(value[index], starts) / (lengths + PRIOR) + offset
        for own, y, end in zip(bags, labels_of, ends):
            if not own:
                continue
            scores = every[end - len(own) : end]
            top = int(scores.argmax())
            p = 1 / (1 + np.exp(-scores[top]))
            trusted = k < TRUSTING or (p > TRUST[0] if y else p < TRUST[1])
            if trusted:
                chosen.append(own[top])
                labels.append(y)
                scale.append(1.0 if not y or p > 0.5 or k < TRUSTING else 0.5)
            others = [i for i in range(len(own)) if i != top and scores[i] < (0 if y else 2)]
            short = [] if y else [i for i in others if len(own[i]) <= SHORT]
            for i in [*rng.permutation(others)[:OTHERS], *rng.permutation(short)[:OTHERS]]:
                chosen.append(own[int(i)])
                labels.append(0)
                scale.append(0.7)
        passes = max(PASSES, math.ceil(LEAST_STEPS / math.ceil(len(chosen) / BATCH)))
        model.fit(chosen, np.array(labels, int), passes, rng, np.array(scale))
        value, offset = model.values()
    return value, offset


class Scorer:
    """Scores of texts by the values of their features, a batch at a time."""

    def __init__(self, value: np.ndarray, offset: float):
        self.value, self.offset = value.astype(np.float64), offset
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 3))

    def _word(self, w: str) -> int:
        features = word_features(w)
        self.place[w] = k = len(self.place)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.value[features].sum(), len(features), features[0]
        return k

    def scores(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """(score, the sentence that has it) of each text; 0 and '' for one without words."""
        if len(self.place) > 400_000:
            self.place = {}
        ids: list[int] = []
        lengths: list[int] = []
        owner: list[int] = []
        kept: list[str] = []
        get = self.place.get
        for k, text in enumerate(texts):
            for s in segments(text):
                found = tokens(s)
                if found:
                    known = [get(w) for w in found]
                    if None in known:
                        known = [self._word(w) if (i := get(w)) is None else i for w in found]
                    ids += known
                    lengths.append(len(found))
                    owner.append(k)
                    kept.append(s)
        best: list[tuple[float, str]] = [(0.0, "")] * len(texts)
        if not ids:
            return best
        table = self.table
        at = np.array(ids)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        own = table[at, 2].astype(np.int64)
        pair = np.zeros(len(at))
        pair[:-1] = self.value[pair_buckets(own[:-1], own[1:])]
        ends = starts + np.array(lengths) - 1
        pair[ends] = 0.0
        total = np.add.reduceat(table[at, 0] + pair, starts)
        count = np.add.reduceat(table[at, 1], starts) + np.array(lengths) - 1
        p = 1 / (1 + np.exp(-(total / (count + PRIOR) + self.offset)))
        for k, score, s in zip(owner, p.tolist(), kept):
            if score > best[k][0]:
                best[k] = (score, s)
        return best


def labelled(documents: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, label) of labelled documents by the majority of their votes; ties are left out, repeated documents count once.

    At most ``LABELLED_DOCUMENTS`` of each label, chosen by a hash of their id, so that the rarer one is well represented.
    """
    votes = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("share")).where("share <> 0.5")
    chosen = None
    for y, most in enumerate(LABELLED_DOCUMENTS):
        part = votes.where(F.col("share") > 0.5 if y else F.col("share") < 0.5).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("share").alias("share")).orderBy("doc_id").collect()
    return [(r["text"], int(r["share"] > 0.5)) for r in rows if r["text"]]


def abuse_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score): each document's score, that of its most suspicious sentence.

    The classifier is fitted on the votes alone, those on at most ``LABELLED_DOCUMENTS`` documents; every document is scored, whole, in one pass without a shuffle. Null
    and empty texts score 0; repeated documents come out as often as they stand.
    """
    sent = documents.sparkSession.sparkContext.broadcast(train(labelled(documents, labels)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*sent.value)
        for pdf in batches:
            found = [s for s, _ in scorer.scores([None if pd.isna(t) else t for t in pdf["text"]])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": found})

    return documents.select("doc_id", "source", "text").mapInPandas(score, "doc_id long, source string, score double")


def abusive_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that count as abusive."""
    return abuse_scores(documents, labels).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def source_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_documents, n_abusive, rate) of each source."""
    return abuse_scores(documents, labels).groupBy("source").agg(
        F.count("*").alias("n_documents"), F.count_if(F.col("score") >= THRESHOLD).alias("n_abusive"), F.avg((F.col("score") >= THRESHOLD).cast("double")).alias("rate")
    )
