"""Texts of varying token length into containers of fixed capacity, by multiway differencing."""

from __future__ import annotations

import base64
import heapq
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertrace.session import written

#: Tokens of a container, unless the caller says otherwise.
CAPACITY = 2048
#: Items that are packed together; a larger table is packed in as many blocks as it needs, each in a task of its own.
BLOCK_ITEMS = 2048
#: Most tasks that pack; their number is set, as the bytes moved are too few for it to follow from them.
SPREAD = 2000
#: The vocabulary of a public byte-level tokenizer, as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of that tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id long, piece int, first_token long, n_tokens int, salt long"
PACKED = "doc_id long, piece int, first_token long, n_tokens int, window_id long"


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


#: A window: its fill, a number that tells equal fills apart, its items.
Window = tuple[int, int, list[int]]


def merge(a: list[Window], b: list[Window], k: int) -> list[Window]:
    """Two partial partitions into ``k`` windows as one: the fullest of either meets the emptiest of the other.

    Empty windows aren't listed; while there are some left, the filled windows of both stand side by side, in no
    order. All ``k`` filled, they are listed by rising fill; a partition of few windows is put into it in place.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) + len(b) <= k:
        a.extend(b)
        if len(a) == k:
            a.sort()
        return a
    if len(a) < k:
        a.sort()
    b.sort(reverse=True)
    free = k - len(a)  # empty windows take the fullest of b
    low = a[: len(b) - free] if len(b) > free else []
    del a[: len(low)]
    added = b[:free]
    for (x, n, items), (y, _, more) in zip(low, b[free:]):
        items.extend(more)
        added.append((x + y, n, items))
    if len(added) * 16 < k:
        for w in added:
            insort(a, w)
    else:
        a += added
        a.sort()
    return a


def difference(sizes: list[int], k: int) -> list[Window]:
    """``k`` windows at most, by largest differencing: the two most uneven partial partitions are merged until one is left."""
    heap: list[tuple[int, int, list[Window]]] = [(-s, i, [(s, i, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        x, _, a = heapq.heappop(heap)
        y, _, b = heapq.heappop(heap)
        merged = merge(a, b, k)
        # while a window is empty the spread is the largest fill, which one of both had
        spread = merged[-1][0] - merged[0][0] if len(merged) == k else max(-x, -y)
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    return heap[0][2] if heap else []


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of items, none fuller than ``capacity``, where no item is larger.

    Items with which no other fits have a window of their own. For the rest, the window count starts at the least that could hold all and rises while a window is too full; the first
    steps grow, then the count is drawn back to the least that was found to do.
    """
    if not sizes:
        return []
    smallest = min(sizes)
    alone = [i for i, s in enumerate(sizes) if s + smallest > capacity]
    if alone and len(alone) < len(sizes):
        rest = [i for i, s in enumerate(sizes) if s + smallest <= capacity]
        return [[i] for i in alone] + [[rest[j] for j in w] for w in pack([sizes[i] for i in rest], capacity)]
    least = max(1, -(-sum(sizes) // capacity))

    def fit(k: int) -> list[list[int]] | None:
        windows = difference(sizes, k)
        return None if any(w[0] > capacity for w in windows) else [w[2] for w in windows]

    low, step, found = least - 1, 1, None
    k = least
    while True:
        found = fit(k)
        if found is not None or k >= len(sizes):
            break
        low, k, step = k, min(len(sizes), k + step), step * 2
    if found is None:
        return [[i] for i in range(len(sizes))]
    high = k
    while high - low > 1:
        mid = (low + high) // 2
        tried = fit(mid)
        if tried is not None:
            found, high = tried, mid
        else:
            low = mid
    return found


def measured_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, salt): each text's length in tokens; a text beyond the capacity in pieces of it.

    All pieces of such a text but the last are full. Special tokens in a text count as ordinary text. Null and
    empty texts give no piece.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                n = 0 if not text or pd.isna(text) else len(encode(text))
                for p, at in enumerate(range(0, n, capacity)):
                    rows.append((doc, p, at, min(capacity, n - at), xxhash.xxh32_intdigest(text)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "first_token", "n_tokens", "salt"])

    return documents.select("doc_id", "text").mapInPandas(measure, PIECES)


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, window_id): every piece of every text in a window of at most ``capacity`` tokens.

    Pieces are dealt to blocks of about ``BLOCK_ITEMS`` by a hash; only lengths are moved, no texts. Repeated
    documents are packed as often as they stand; ties are broken by (doc_id, piece). Other columns are ignored.
    """
    pieces = written(measured_pieces(documents, capacity, vocabulary))
    blocks = max(1, -(-pieces.count() // BLOCK_ITEMS))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "salt"], ignore_index=True)
        window = [0] * len(pdf)
        for w, items in enumerate(pack(pdf["n_tokens"].tolist(), capacity)):
            for i in items:
                window[i] = w
        base = int(pdf["block"].iloc[0]) << 20
        return pdf[["doc_id", "piece", "first_token", "n_tokens"]].assign(window_id=[base + w for w in window])

    return pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(blocks))).repartition(min(blocks, SPREAD), "block").groupBy("block").applyInPandas(fill, PACKED)


def window_report(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(window_id, n_items, used, unused) of each window."""
    return packed(documents, capacity, vocabulary).groupBy("window_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("used"), (F.lit(capacity) - F.sum("n_tokens")).alias("unused"))
