"""Near-duplicate documents by BagMinHash signatures of word shingles.

A document is the multiset of its runs of five words. Every shingle carries a Poisson process over
weight and time: the weight axis is cut into the levels (0, 1], (1, 2], (2, 4], (4, 8] and so on, a
level's points come from one hashed stream with its width as rate, and the place of a point inside its
level is found by hashed halving. A shingle of weight w owns the points below w. Each point falls into
one of the signature's slots, and a slot keeps its earliest point, so two slots agree with the weighted
Jaccard similarity as probability. Only points up to a time that shrinks with the document's weight are
made; a slot that stays empty makes the document look further. Slots are banded, and candidate pairs
are verified by the exact multiset overlap.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from .common import frugal, prepare_workers, table
from .components import connected_components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4  # a pair at 0.8 meets in some band with probability 0.9998
SLOTS = BANDS * ROWS
LEAST_AGREEMENT = 0.5  # of the slots, six deviations below 0.8: such pairs are not read in full
BLOCK = 400
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input changes about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the distinct runs of five words; a shorter text is one run."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    out = codes[:n].copy()
    for i in range(1, size):
        out = mix(out) + codes[i : i + n]
    return np.unique(mix(out + np.uint64(size)), return_counts=True)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` times per bag; an empty bag has infinity everywhere."""
    out = np.full((len(bags), slots), np.inf)
    total = np.array([float(n.sum()) for _, n in bags])
    # After this time a slot is still empty with probability exp(-7).
    limit = np.where(total > 0, 7.0 / np.maximum(total, 1), 0.0)
    waiting = np.flatnonzero(total > 0)
    while len(waiting):
        sizes = [len(bags[b][0]) for b in waiting]
        owner = np.repeat(waiting, sizes)
        element = np.concatenate([bags[b][0] for b in waiting])
        weight = np.concatenate([bags[b][1] for b in waiting])
        level = 0
        while len(owner):
            low, high = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
            _points(out, owner, mix(element + np.uint64(int(_STEP) * (level + 1) % 2**64)), weight, low, high, limit, slots)
            more = weight > high
            owner, element, weight = owner[more], element[more], weight[more]
            level += 1
        waiting = waiting[np.isinf(out[waiting]).any(1)]
        limit[waiting] *= 2
    return out


def _points(out, owner, seed, weight, low, high, limit, slots) -> None:
    """Put the points of one weight level up to each owner's time limit into the slots."""
    rate = 1.0 / (slots * (high - low))
    time = np.zeros(len(owner))
    flat = out.reshape(-1)
    state = seed
    while len(owner):
        state = mix(state + _STEP)
        time = time - np.log(_uniform(state)) * rate
        early = time <= limit[owner]
        owner, time, state, weight = owner[early], time[early], state[early], weight[early]
        detail = mix(state ^ _BASE)
        slot = (detail % np.uint64(slots)).astype(np.int64)
        at = owner * slots + slot
        if high - low > 1:
            inside = _halve(detail, low, high) < weight
            np.minimum.at(flat, at[inside], time[inside])
        else:
            np.minimum.at(flat, at, time)


def _halve(detail: np.ndarray, low: int, high: int) -> np.ndarray:
    """The unit interval of the level in which each point lies: one hashed bit per halving."""
    place = np.full(len(detail), low, np.int64)
    width, bits = (high - low) >> 1, mix(detail + _BASE)
    while width:
        place += np.where(bits & np.uint64(1), width, 0)
        bits, width = bits >> np.uint64(1), width >> 1
    return place


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, bits.shape[:2]).copy()
    for row in range(ROWS):
        key = mix(key + bits[:, :, row])
    return key.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (total - shared)


def _words_of(text: str) -> list[str]:
    return text.lower().split()


@frugal
def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        nodes, bags, keys, size = [], [], [], 0
        for file, index, text in zip(batch["file"], batch["index"], batch["text"], strict=True):
            words = _words_of(text)
            # Equal word sequences are one node; a text without words is a node of its own.
            name = " ".join(words).encode() if words else b"\x00row %d %d" % (file, index)
            nodes.append(hashlib.md5(name, usedforsecurity=False).digest())
            bags.append(shingles(words))
            size += len(bags[-1][0])
            if size > 100_000:
                keys += list(band_keys(signatures(bags)))
                bags, size = [], 0
        keys += list(band_keys(signatures(bags))) if bags else []
        yield batch[["file", "index", "doc_id"]].astype({"doc_id": "Int64"}).assign(node=nodes, keys=keys)
    _words.clear()


@lru_cache(maxsize=16)
def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    return shingles(_words_of(text))


def _verify(threshold: float):
    @frugal
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [
                overlap(_bag(a), _bag(b)) >= threshold for a, b in zip(batch["text_a"], batch["text_b"], strict=True)
            ]
            yield batch.loc[np.array(same, bool), ["a", "b"]]
        _bag.cache_clear()

    return verify


def _settle(threshold: float):
    """Links between different components inside one block or between two blocks of a bucket."""

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(key[2]), int(key[3])
        rows = rows.sort_values("node", kind="stable")
        node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
        bags = [shingles(_words_of(t)) for t in rows["text"]]
        signs = signatures(bags)
        total = np.array([b[1].sum() for b in bags])
        part = pd.factorize(rows["component"])[0]
        links = []
        for i in range(len(rows)):
            near = (part[i + 1 :] != part[i]) & (np.minimum(total[i + 1 :], total[i]) >= threshold * np.maximum(total[i + 1 :], total[i]))
            if low != high:
                near &= block[i + 1 :] != block[i]
            for j in np.flatnonzero(near) + i + 1:
                if part[j] == part[i] or (signs[i] == signs[j]).mean() < LEAST_AGREEMENT:
                    continue
                if overlap(bags[i], bags[j]) >= threshold:
                    links.append((node[i], node[j]))
                    part[part == part[j]] = part[i]
        return pd.DataFrame(links, columns=["a", "b"])

    return settle


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """file, index, doc_id, class_id, n_rows, kept for every row of the documents.

    A class holds what is linked, directly or through others, by a weighted Jaccard similarity of word
    shingles of at least ``threshold``; its id is its smallest doc_id, and the row kept is the first one
    of that id. Words are compared in lower case. NULL, empty and blank texts are linked with nothing.
    A NULL id comes last. ``file`` and ``index`` are the row's ``place``, so ``docs`` has to come straight
    from Parquet files.

    Links: every document of a bucket is verified against the bucket's smallest one. In buckets whose
    documents are then still in several components, all pairs of different components are compared,
    block by block, without writing pairs out.
    """
    prepare_workers(docs.sparkSession)
    file, index = place(docs)
    rows = docs.select(file.alias("file"), index.alias("index"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = store(rows.mapInPandas(_sign, "file long, index long, doc_id long, node binary, keys array<long>"), "signatures")
    nodes = signed.groupBy("node").agg(F.min(F.struct("file", "index")).alias("place"), F.first("keys").alias("keys"))
    keyed = store(nodes.select("node", "place.*", F.posexplode("keys").alias("band", "key")), "band-keys")
    hubs = store(
        keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"), "hubs"
    )
    member = keyed.join(hubs, ["band", "key"])
    pairs = store(member.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = member.select("node", "file", "index").distinct()
    texts = store(rows.join(wanted, ["file", "index"]).select("node", "text"), "candidate-texts")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    links = store(pairs.join(left, "a").join(right, "b").mapInPandas(_verify(threshold), "a binary, b binary"), "links")
    found = connected_components(links)
    placed = store(
        member.join(found, "node", "left").select(
            "band", "key", "node", F.coalesce("component", "node").alias("component")
        ),
        "placed",
    )
    # Buckets that still hold several components; of buckets with the same members only one.
    open_buckets = (
        placed.groupBy("band", "key")
        .agg(
            F.min("component").alias("first"), F.max("component").alias("last"), F.count("*").alias("n"),
            F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"),
        )
        .where("first <> last")
        .groupBy("n", "sum", "first", "last")
        .agg(F.min(F.struct("band", "key")).alias("bucket"))
        .select("bucket.*", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    open_buckets = store(open_buckets, "open-buckets")
    blocked = (
        placed.join(open_buckets, ["band", "key"])
        .join(texts, "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "component", "text", "block")
    )
    more = blocked.groupBy("band", "key", "low", "high").applyInPandas(_settle(threshold), "a binary, b binary")
    more = store(more, "more-links")
    if more.limit(1).count():
        found = connected_components(links.union(more))
    classed = signed.drop("keys").join(found, "node", "left").select(
        "file", "index", "doc_id", F.coalesce("component", "node").alias("class")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "index"))
    classed = store(classed, "classed")
    classes = store(classed.groupBy("class").agg(first.alias("first"), F.count("*").alias("n_rows")), "classes")
    kept = (F.col("file") == F.col("first.file")) & (F.col("index") == F.col("first.index"))
    return classed.join(classes, "class").select(
        "file", "index", "doc_id", F.col("first.doc_id").alias("class_id"), "n_rows", kept.alias("kept")
    )


def place(docs: DataFrame) -> tuple[Column, Column]:
    """Hash of the row's file and its number there.

    The same in every scan of the files however they are split; numbers that follow the partitions
    change when executors come or go between two scans, as the split follows the number of cores.
    """
    about = docs.metadataColumn("_metadata")
    return F.xxhash64(about["file_path"]), about["row_index"]


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns; see ``near_duplicates``."""
    found = near_duplicates(docs, threshold)
    dropped = found.where(~F.col("kept")).select(F.col("file").alias("__file"), F.col("index").alias("__index"))
    file, index = place(docs)
    marked = docs.withColumns({"__file": file, "__index": index})
    return marked.join(store(dropped, "dropped-rows"), ["__file", "__index"], "left_anti").select(*marked.columns[:-2])


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("file", "index")
