"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in lower case with white space collapsed. An item of n characters with at most k
edits still shares n - q + 1 - q k of its q-grams with the document, all on diagonals no more than k
apart. Shared q-grams are counted in the overlapping bands of k + 1 diagonals that begin at each of
them; where a band reaches the bound, a banded alignment of the item with that stretch of the document decides. Overlapping windows of long
items are sought in the same way, each with its own edits, so a copy of a part is found too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from .common import frugal, id_and_text, prepare_workers, table

Q = 8
RATE = 0.1  # edits per character of the item
BLOCK_CHARS = 2_000_000
WINDOW, STRIDE = 50, 20  # words; so 69 words in a row hold a whole window
TABLE_BITS = 22
BASE = np.uint64(0x100000001B3)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    if len(codes) < q:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    n = len(codes) - q + 1
    out = wide[:n].copy()
    for i in range(1, q):
        out *= BASE
        out += wide[i : i + n]
    return out * SPREAD


def budget(n: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed in an item of n characters: the rate, or fewer where the lemma needs one q-gram."""
    return max(0, min(int(rate * n), (n - q) // q))


def patterns(text: str) -> list[str]:
    """The normalised item, then its windows if it has more than ``WINDOW`` words."""
    words = text.split(" ")
    last = len(words) - WINDOW
    starts = [*range(0, last, STRIDE), last] if last > 0 else []
    return [text, *(w for w in (" ".join(words[a : a + WINDOW]) for a in starts) if len(w) >= Q)]


@dataclass
class Index:
    """The q-grams of a block of items and windows: sorted hashes, their places, and a bit table in front."""

    ids: list
    owner: list[int]  # item of each pattern
    items: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    edits: np.ndarray
    need: np.ndarray  # shared q-grams that the lemma asks for

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Index:
        cut = [(i, part) for i, (_, text) in enumerate(rows) for part in patterns(text)]
        owner, items = [i for i, _ in cut], [code_points(part) for _, part in cut]
        hashes = [gram_hashes(c) for c in items]
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        bits = np.zeros(1 << TABLE_BITS, bool)
        bits[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        sizes = np.array([len(c) for c in items], np.int64)
        edits = np.array([budget(n) for n in sizes.tolist()], np.int64)
        ids, ends = [i for i, _ in rows], np.append(first, len(every))
        return cls(ids, owner, items, keys, ends, item[order], place[order], bits, edits, sizes - Q + 1 - Q * edits)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, edits, start, end) per item found, in the normalised text.

        Of an item that is not found whole it is the window with the fewest edits, then the first.
        """
        codes = code_points(text)
        hashes = gram_hashes(codes)
        if not len(hashes) or not len(self.keys):
            return []
        near = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[near]
        near, at = near[hit], at[hit]
        if not len(near):
            return []
        times = self.first[at + 1] - self.first[at]
        total = int(times.sum())
        posting = np.repeat(self.first[at], times) + np.arange(total) - np.repeat(np.cumsum(times) - times, times)
        item = self.item[posting]
        diagonal = np.repeat(near, times) - self.place[posting]
        # The edits move a match by as many diagonals at most: every band of so many counts on its own.
        shift = np.int64(1) << 40
        half = shift >> 1
        shared = np.sort(item * shift + diagonal + half)
        item = shared // shift
        count = np.searchsorted(shared, shared + self.edits[item], side="right") - np.arange(total)
        enough = count >= self.need[item]
        item = item[enough]
        cells = np.unique(item * shift + (shared[enough] % shift - half) // (self.edits[item] + 1) + half)
        item = cells // shift
        best: dict[int, tuple[int, int, int, int]] = {}
        for k, i in enumerate(item.tolist()):
            if i in best and best[i][1] == 0:
                continue
            width = int(self.edits[i]) + 1
            low = int(cells[k] % shift - half) * width
            # Bands that begin in this cell reach into the next; the alignment may begin in the cell
            # before, where no q-gram was left whole.
            found = align(self.items[i], codes, low - width, 3 * width, int(self.edits[i]))
            if found and (i not in best or found[0] < best[i][1]):
                best[i] = (i, *found)
        found: dict[int, tuple[bool, tuple[int, int, int]]] = {}
        for k in sorted(best):  # an item stands before its windows
            i, match = self.owner[k], best[k][1:]
            whole = k == 0 or self.owner[k - 1] != i
            if whole or i not in found or not found[i][0] and match < found[i][1]:
                found[i] = (whole, match)
        return [(i, *match) for i, (_, match) in found.items()]


def align(item: np.ndarray, codes: np.ndarray, low: int, width: int, edits: int) -> tuple[int, int, int] | None:
    """Fewest edits, start and end of the item in the text on diagonals low to low + width - 1.

    Both ends in the text are free. None above ``edits``. Among equals the leftmost end.
    """
    n = len(item)
    stretch = np.zeros(n + width, np.int64) - 1
    a, b = max(0, low), min(len(codes), low + n + width)
    if a < b:
        stretch[a - low : b - low] = codes[a:b]
    across = np.lib.stride_tricks.sliding_window_view(stretch, width)[:n]
    differ = across != item[:, None]
    plain = differ.sum(0)
    if (plain == 0).any():
        start = low + int(plain.argmin())
        return 0, start, start + n
    steps = np.arange(width)
    cost = np.zeros(width, np.int64)
    begin = low + steps
    for row in range(n):
        here, origin = cost + differ[row], begin
        # Leaving out a character of the item comes from the next diagonal.
        skip = np.append(cost[1:] + 1, edits + n + 1)
        better = skip < here
        here = np.where(better, skip, here)
        origin = np.where(better, np.append(begin[1:], 0), origin)
        # A character that only the text has comes from the diagonal before, any number of times.
        run = here - steps
        lowest = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == lowest, steps, 0))
        cost, begin = lowest + steps, origin[source]
        if cost.min() > edits:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), low + n + end


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalised items of at least Q characters, a block of about ``chars`` characters at a time."""
    part, size = [], 0
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = normal(row["text"])
        if len(text) < Q:
            continue
        more = sum(map(len, patterns(text)))
        if part and size + more > chars:
            yield part
            part, size = [], 0
        part.append((row["item_id"], text))
        size += more
    if part:
        yield part


_MATCH = "doc_id long, item_id long, edits int, start long, end long"


def _find(shared):
    @frugal
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            rows = [
                (doc_id, index.ids[i], edits, start, end)
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True)
                for i, edits, start, end in index.matches(normal(text))
            ]
            frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "start", "end"])
            yield frame.astype({"doc_id": "Int64", "item_id": "Int64", "edits": "int32", "start": "int64", "end": "int64"})

    return find


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, edits, start, end.

    An item is held whole or by a window of ``WINDOW`` of its words, each with its own budget of edits;
    edits and positions are those of the whole item if it is there, else of its best window.
    Positions are in the normalised text. Repeated document rows give repeated matches. NULL and empty
    texts match nothing; items of fewer than Q characters are no evidence and match nothing. Items
    with a NULL id are sought like others and give a NULL item_id; those with a NULL text are not. A large
    benchmark is worked off in blocks, so a task holds one block of items at a time.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    texts, found = id_and_text(docs), []
    for part in blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(Index.of(part))  # at most block_chars, or one item
        found.append(store(texts.mapInPandas(_find(shared), _MATCH), "leaks"))
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], _MATCH)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _holds(shared):
    @frugal
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bool(shared.value.matches(normal(t))) for t in texts], dtype="bool")

    return F.pandas_udf(holds, "boolean")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: Column | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    spark = docs.sparkSession
    prepare_workers(spark)
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    waiting = None
    for part in blocks(benchmark, block_chars):
        if waiting is not None:
            docs = store(docs, "clean-so-far")
        waiting = spark.sparkContext.broadcast(Index.of(part))
        docs = docs.where(~_holds(waiting)(text))
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
