"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a word with the word mark in front. Its unigram segmentation has the smallest cost;
among equals the fewest tokens. The forward costs are computed once per trie node, depth by depth
for all nodes of a depth together, so words that begin alike share that work. Words that end at a
node take the count stored there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import id_and_text, table

MARK = "▁"
COUNT_BITS = 20
UNKNOWN_COST = 14_000  # per byte of a character that is in no piece
CACHE = 400_000
PADDING = np.uint32(0xFFFFFFFF)  # no character, unlike the 0 that numpy fills up with
ALONE = 64  # longer words take the same recurrence one by one
BASE = np.uint64(0x9E3779B97F4A7C15)


def _cost(points: int, tokens: int = 1) -> int:
    """Cost and number of tokens in one integer: sums compare by cost, then by tokens.

    Words of at most ``ALONE`` characters stay far below 2^COUNT_BITS tokens; ``one`` keeps the two apart.
    """
    return (points << COUNT_BITS) + tokens


class Vocabulary:
    """Pieces of a public tokenizer with unigram costs.

    The file orders pieces by merge, without probabilities; the cost of the piece of rank r is
    -1000 ln of 1 / (r + 10), as in Zipf's law.
    """

    def __init__(self, name: str = "piece_bpe_32k.model"):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.costs: dict[str, int] = {}
        rank = 0
        for i in range(model.get_piece_size()):
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)):
                self.costs[model.id_to_piece(i)] = _cost(round(1000 * math.log(rank + 10)))
                rank += 1
        self.longest = max(map(len, self.costs))
        self.hashes: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        for size in range(1, self.longest + 1):
            pieces = [p for p in self.costs if len(p) == size]
            keys = np.zeros(len(pieces), np.uint64)
            for i in range(size):
                keys = keys * BASE + np.array([ord(p[i]) for p in pieces], np.uint64)
            order = np.argsort(keys)
            self.hashes.append((keys[order], np.array([self.costs[p] for p in pieces], np.int64)[order]))

    def one(self, word: str) -> int:
        """Tokens of one pre-token, character by character."""
        last = [(0, 0)]  # best (cost, tokens) of the last prefixes, the whole one at the end
        for end in range(1, len(word) + 1):
            char = len(word[end - 1].encode())
            least = last[-1][0] + UNKNOWN_COST * char, last[-1][1] + char
            for size in range(1, min(self.longest, end) + 1):
                cost = self.costs.get(word[end - size : end])
                if cost is not None:
                    points, number = last[-size]
                    least = min(least, (points + (cost >> COUNT_BITS), number + 1))
            last.append(least)
            if len(last) > self.longest:
                del last[0]
        return last[-1][1]

    def many(self, words: list[str]) -> dict[str, int]:
        """Tokens of distinct pre-tokens through their common trie."""
        counts = {w: self.one(w) for w in words if len(w) > ALONE}
        short = sorted(w for w in words if len(w) <= ALONE)
        if short:
            counts.update(zip(short, self._trie(short).tolist(), strict=True))
        return counts

    def _trie(self, words: list[str]) -> np.ndarray:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        letters = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
        letters[np.arange(width) >= sizes[:, None]] = PADDING
        # Sorted words share a node exactly as far as they agree with the word before.
        shared = np.full(len(words), -1)
        if len(words) > 1:
            differ = letters[1:] != letters[:-1]
            shared[1:] = np.where(differ.any(1), differ.argmax(1), width)
        result = np.zeros(len(words), np.int64)
        rows = np.arange(len(words))
        node_of = np.zeros(len(words), np.int64)
        costs = [np.zeros(1, np.int64)]  # best cost per node: this depth last, then its ancestors
        suffixes: list[np.ndarray] = []  # hash of the last 1, 2, ... letters per node
        ancestors: list[np.ndarray] = [np.zeros(1, np.int64)]
        for depth in range(1, width + 1):
            rows = rows[sizes[rows] >= depth]
            new = shared[rows] < depth
            first = rows[new]
            parent = node_of[first]
            letter = letters[first, depth - 1].astype(np.uint64)
            nodes = len(first)
            node_of[rows] = np.cumsum(new) - 1
            span = min(depth, self.longest)
            ancestors = [parent] + [a[parent] for a in ancestors[: span - 1]]
            suffixes = [letter] + [s[parent] * BASE + letter for s in suffixes[: span - 1]]
            width_of = 1 + (letter >= 0x80) + (letter >= 0x800) + (letter >= 0x10000)
            best = costs[-1][parent] + ((UNKNOWN_COST * width_of.astype(np.int64)) << COUNT_BITS) + width_of
            for size in range(1, span + 1):
                keys, price = self.hashes[size]
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, suffixes[size - 1]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == suffixes[size - 1])
                if len(hit):
                    total = costs[-size][ancestors[size - 1][hit]] + price[at[hit]]
                    best[hit] = np.minimum(best[hit], total)
            costs = [*costs[-self.longest :], best]
            ends = rows[sizes[rows] == depth]
            result[ends] = best[node_of[ends]]
            assert nodes == len(best)
        return result & ((1 << COUNT_BITS) - 1)


@lru_cache(maxsize=4)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def _count(name: str):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        pieces = vocabulary(name)
        for texts in batches:
            out, part, fresh, seen = [], [], set(), 0
            for text in texts:
                words = text.split()
                part.append(words)
                fresh.update(w for w in words if w not in known)
                seen += len(words)
                if seen >= 500_000:
                    out += _settle(part, fresh, known, pieces)
                    part, fresh, seen = [], set(), 0
            out += _settle(part, fresh, known, pieces)
            yield pd.DataFrame(out, columns=["n_pretokens", "n_tokens"]).astype("int64")

    return count


def _settle(part, fresh, known, pieces) -> list[tuple[int, int]]:
    known.update((w[1:], n) for w, n in pieces.many([MARK + w for w in fresh]).items())
    rows = [(len(words), sum(map(known.__getitem__, words))) for words in part]
    if len(known) > CACHE:
        known.clear()
    return rows


def token_counts(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row, also repeated ones.

    A NULL, empty or blank text has 0 of both. Words are separated by any white space.
    """
    ship_package(docs.sparkSession)
    counted = F.pandas_udf(_count(name), "n_pretokens long, n_tokens long")
    return id_and_text(docs).select("doc_id", counted(F.col("text")).alias("counts")).select("doc_id", "counts.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
