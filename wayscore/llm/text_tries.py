"""Exact copies of texts, found by compressed tries over ranges of texts.

Every task first inserts its texts into tries of its own, so of a text's rows it passes on only those
with its smallest id. These are dealt out by ranges of text prefixes; a prefix is as long as it must
be to hold no more than a small part of all bytes. A range is read in the order of its prefixes; full
texts go into a trie whose terminals hold the smallest id, and where one is full, the next prefix
starts a new one, so that a range may hold more than its share.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import frugal, prepare_workers

LOCAL_BYTES = 32 << 20  # of texts and nodes in a trie
RANGE_BYTES = 128 << 20  # of texts and nodes in a range
NODE_BYTES = 800  # what Python takes for a node, its edge and its value; more than the text of a short one
SPLIT = 4  # a prefix may hold 1 / SPLIT of a range's share of the bytes
FIRST_LENGTH, GROWTH = 4, 4  # bytes of the shortest prefix, and how much longer the next one is
OUT_ROWS, OUT_BYTES = 4_000, 8 << 20


class TextTrie:
    """A compressed trie of byte strings. A node is ``[value, edges]``, an edge ``first byte: (label, node)``."""

    def __init__(self):
        self.root: list = [None, {}]
        self.bytes, self.nodes = 0, 1

    @property
    def size(self) -> int:
        return self.bytes + NODE_BYTES * self.nodes

    def terminal(self, text: bytes) -> list:
        """The node at the end of ``text``, made if it isn't there; its value can be set."""
        node, at = self.root, 0
        while at < len(text):
            edge = node[1].get(text[at])
            if edge is None:
                leaf: list = [None, {}]
                node[1][text[at]] = (text[at:], leaf)
                self.bytes += len(text) - at
                self.nodes += 1
                return leaf
            label, below = edge
            if not text.startswith(label, at):
                n = shared_start(label, text, at)
                below = [None, {label[n]: (label[n:], below)}]
                node[1][text[at]] = (label[:n], below)
                self.nodes += 1
                at += n
            else:
                at += len(label)
            node = below
        return node

    def walk(self) -> Iterator[tuple[bytes, object]]:
        """(text, value) of every terminal, in no order."""
        waiting = [(b"", self.root)]
        while waiting:
            start, (value, edges) = waiting.pop()
            if value is not None:
                yield start, value
            waiting += [(start + label, node) for label, node in edges.values()]


def shared_start(label: bytes, text: bytes, at: int) -> int:
    """How many first bytes ``label`` and ``text[at:]`` share; they are known to differ."""
    low, step = 0, 16
    while label[low : low + step] == text[at + low : at + low + step]:
        low += step
        step *= 2
    while step > 1:
        step //= 2
        if label[low : low + step] == text[at + low : at + low + step]:
            low += step
    return low


class Copies:
    """Rows (text, id, tag) with their numbers, merged to those with the smallest id of their text."""

    def __init__(self):
        self.trie = TextTrie()

    def add(self, text: bytes, key: int, tags: Counter) -> tuple[int, Counter] | None:
        """Take in rows of one text and id; give back the id and tags of those now known to be copies."""
        node = self.trie.terminal(text)
        if node[0] is None:
            node[0] = (key, tags)
        elif key > node[0][0]:
            return key, tags
        elif key == node[0][0]:
            node[0][1].update(tags)
        else:
            late, node[0] = node[0], (key, tags)
            return late
        return None


_ROW = "text binary, doc_id long, tag string, marks int, copy boolean, n long"
_KINDS = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64()]
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


class _Out:
    """Rows on their way out, a batch at a time."""

    def __init__(self, width: slice):
        self.width, self.rows, self.bytes = width, [], 0

    def put(self, text: bytes | None, key: int | None, tags: Counter, copy: bool) -> None:
        for (tag, marks), n in tags.items():
            self.rows.append((text, key, tag, marks, copy, n)[self.width])
            self.bytes += len(text or b"")

    def ready(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES):
            kinds, names = _KINDS[self.width], _NAMES[self.width]
            columns = [pa.array(x, k) for x, k in zip(zip(*self.rows, strict=True), kinds, strict=True)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, names)


def _first_rows(marks_of: Callable[[bytes], int], most: int):
    """Per task and trie: rows with the smallest id keep their text, all others are known copies."""

    @frugal
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, out, marks = Copies(), _Out(slice(None)), {}

        def flush():
            for text, (key, tags) in copies.trie.walk():
                out.put(text, key, tags, False)
                yield from out.ready()

        for batch in batches:
            for text, key, tag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                node = copies.trie.terminal(text)
                mark = marks.get(id(node))
                if mark is None:
                    mark = marks[id(node)] = marks_of(text)
                tags = Counter({(tag, mark): 1})
                known = (None, tags) if key is None else copies.add(text, key, tags)
                if known:
                    out.put(None, *known, key is not None)
                yield from out.ready()
                if copies.trie.size >= most:
                    yield from flush()
                    copies, marks = Copies(), {}
        yield from flush()
        yield from out.ready(last=True)

    return work


def _last_rows(most: int):
    """Per range, its rows in the order of their prefixes: equal texts have equal prefixes, so a trie that
    is full can be closed where the next prefix starts."""

    @frugal
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, out, prefix = Copies(), _Out(slice(1, None)), None

        def flush():
            for _, (key, tags) in copies.trie.walk():
                out.put(None, key, tags, False)
                yield from out.ready()

        for batch in batches:
            for text, taken, key, tag, marks, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if copies.trie.size >= most and text[:taken] != prefix:
                    yield from flush()
                    copies = Copies()
                prefix = text[:taken]
                known = copies.add(text, key, Counter({(tag, marks): n}))
                if known:
                    out.put(None, *known, True)
                    yield from out.ready()
        yield from flush()
        yield from out.ready(last=True)

    return work


def adaptive_prefix(rows: DataFrame, text: str, limit: float) -> DataFrame:
    """``rows`` with ``taken``, the length of the start of ``text`` that sorts it into a range: ``FIRST_LENGTH``
    bytes, and more where rows that share them have more than ``limit`` bytes of texts and nodes.

    It is a function of the text alone. Hashes of the prefixes above the limit, per length at most all
    bytes / limit of them, are stored and joined, by the optimizer's choice. Prefixes with equal hashes
    would only both be longer.
    """
    length, size = FIRST_LENGTH, F.octet_length(text)
    out = rows.withColumn("taken", F.lit(length))
    while True:
        open_ = (F.col("taken") == length) & (size > length)
        name = F.xxhash64(F.substring(text, 1, length))
        sums = out.where(open_).groupBy(name.alias("prefix")).agg(F.sum(size + NODE_BYTES).alias("bytes"))
        heavy = store(sums.where(F.col("bytes") > limit).select("prefix"), "heavy-prefixes")
        if heavy.isEmpty():
            return out
        longer = F.when(open_ & F.col("prefix").isNotNull(), length * GROWTH).otherwise(F.col("taken"))
        out = out.join(heavy, name == heavy["prefix"], "left").select(*rows.columns, longer.alias("taken"))
        length *= GROWTH


def mark_copies(
    docs: DataFrame, tag: Column, marks_of: Callable[[bytes], int],
    local_bytes: int = LOCAL_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """(doc_id, tag, marks, copy, n): n rows of ``docs`` with that id, tag, ``marks_of(text)``, and whether
    a smaller id has the same text. Rows come in several parts, to be summed.

    A NULL text is empty. A row without an id is no copy, and no row is a copy of it. Rows that share
    the smallest id of a text are no copies. Texts are equal if their bytes are.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    rows = docs.select(
        F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag")
    )
    first = store(rows.mapInArrow(_first_rows(marks_of, local_bytes), _ROW), "first-texts")
    known = first.where("text IS NULL").drop("text")
    open_rows = first.where("text IS NOT NULL").drop("copy")
    total = open_rows.agg(F.sum(F.octet_length("text") + F.lit(NODE_BYTES).cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / range_bytes))
    measured = adaptive_prefix(open_rows, "text", max(1.0, total / (SPLIT * parts)))
    prefix = F.substring("text", F.lit(1), F.col("taken"))
    dealt = measured.select("text", "taken", "doc_id", "tag", "marks", "n").repartitionByRange(parts, prefix).sortWithinPartitions(prefix)
    return known.unionByName(dealt.mapInArrow(_last_rows(local_bytes), _ROW.removeprefix("text binary, ")))
