"""Packing documents into token sequences by the online sum-of-squares rule.

Every partition packs its own documents in one pass. A document is tokenized and closed with id 0;
whole sequences are cut off its front, and the rest is placed into the fill level that keeps the sum
over levels of (partly filled windows at that level) squared smallest. The windows left open at the
end are refilled by cutting their pieces freely, and the very last window is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Reference

from .common import frugal, id_and_text, prepare_workers, table

LIMIT = 1024
END_ID = 0
CACHE = 200_000
PIECE_COLUMNS = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
class _Joined(Exception):
    """A part whose ids depend on what stands before it."""


class Tokenizer(dict):
    """Byte-level BPE ids as little-endian unsigned 32-bit integers.

    A space before a character that is no white space always starts a new pre-token, so a text can be
    cut there. Remembers the ids of such parts, at most ``CACHE`` of at most 64 characters. ``ids`` takes
    all text as ordinary; ``document`` gives the added tokens of the JSON beside the ranks, such as
    ``<|endoftext|>``, their own ids, as the reference does by default.
    """

    def __init__(self, name: str = "byte_bpe_50k.tiktoken"):
        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.single = self.coder._core_bpe.encode_single_piece
        self.json = public_tokenizers.path(name.replace(".tiktoken", ".json"))
        with open(self.json, encoding="utf-8") as file:
            self.added = [a["content"] for a in json.load(file)["added_tokens"]]

    def whole(self, text: str) -> bytes:
        return array("I", self.coder.encode_ordinary(text)).tobytes()

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace():
            raise _Joined
        if part.isalpha():  # one pre-token
            ids = array("I", self.single(b" " + part.encode())).tobytes()
        elif part[-1] in ".,;:!?" and part[:-1].isalpha():
            ids = self[part[:-1]] + self.whole(part[-1])
        else:
            ids = self.whole(" " + part)
        if len(part) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        first, *parts = text.split(" ")
        try:
            return self.whole(first) + b"".join(map(self.__getitem__, parts))
        except _Joined:
            return self.whole(text)

    @cached_property
    def reference(self) -> Reference:
        return Reference.from_file(self.json)

    def document(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return array("I", self.reference.encode(text, add_special_tokens=False).ids).tobytes()
        return self.ids(text)


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> Tokenizer:
    if name not in _tokenizers:
        _tokenizers[name] = Tokenizer(name)
    return _tokenizers[name]


class Packer:
    """Windows of ``limit`` tokens, filled online by the sum-of-squares rule.

    ``level[h]`` counts the open windows with h tokens. Finished pieces come out of ``take``; ids are
    kept for open windows only, whose number stays near the number of levels.
    """

    def __init__(self, first_sequence: int, limit: int = LIMIT):
        self.limit, self.sequence = limit, first_sequence
        self.level = np.zeros(limit + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(limit + 1)]
        self.done: list[tuple] = []

    def _close(self, window: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, tokens in window:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, zlib.crc32(ids), tokens, self.sequence, at))
            at += n
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, size = len(ids) // 4, 4 * self.limit
        whole = len(ids) - len(ids) % size
        for at in range(0, whole, size):
            self._close([(doc_id, at // 4, ids[at : at + size], total)])
        if whole < len(ids):
            self._place((doc_id, whole // 4, ids[whole:], total))

    def _place(self, piece: tuple) -> None:
        n, limit, level = len(piece[2]) // 4, self.limit, self.level
        # Change of the sum of squares when a window goes from level h to h + n; h = 0 opens one.
        before, after = level[: limit - n + 1], level[n:]
        change = 2 * (after - before) + 2
        change[limit - n] = 1 - 2 * level[limit - n]
        change[0] = 2 * level[n] + 1
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        # Among equal changes the fullest window.
        h = int(limit - n - np.argmin(change[::-1]))
        window = self.open[h].pop() if h else []
        if h:
            level[h] -= 1
        window.append(piece)
        if h + n == limit:
            self._close(window)
        else:
            level[h + n] += 1
            self.open[h + n].append(window)

    def finish(self) -> None:
        """Fill the open windows from each other, then cut what is left into powers of two."""
        pieces = [p for h in range(self.limit, 0, -1) for w in self.open[h] for p in w]
        left = sum(len(p[2]) // 4 for p in pieces)
        sizes = [self.limit] * (left // self.limit)
        sizes += [1 << b for b in range(self.limit.bit_length(), -1, -1) if left % self.limit >> b & 1]
        at, window, filled = 0, [], 0
        for doc_id, start, ids, tokens in pieces:
            while ids:
                n = min(len(ids) // 4, sizes[at] - filled)
                window.append((doc_id, start, ids[: 4 * n], tokens))
                ids, start, filled = ids[4 * n :], start + n, filled + n
                if filled == sizes[at]:
                    self._close(window)
                    at, window, filled = at + 1, [], 0
        self.open = [[] for _ in range(self.limit + 1)]
        self.level[:] = 0

    def take(self) -> pd.DataFrame:
        columns = [c.split()[0] for c in PIECE_COLUMNS.split(", ")]
        out = pd.DataFrame(self.done, columns=columns)
        self.done = []
        return out.astype({c: "Int64" if c == "doc_id" else "int64" for c in columns})


def _pack(limit: int):
    @frugal
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end = tokenizer(), np.array([END_ID], dtype="<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 36, limit)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                packer.add(None if pd.isna(doc_id) else int(doc_id), coder.document(text) + end)
                if len(packer.done) >= 20_000:
                    yield packer.take()
            yield packer.take()
        packer.finish()
        coder.clear()
        yield packer.take()

    return pack


def pack_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per piece; every id of every row lies in exactly one piece.

    A NULL or empty text is its closing id alone; repeated rows are packed each. Sequences are
    numbered per partition of ``docs``, so a task that is run again gives the same pieces.
    """
    prepare_workers(docs.sparkSession)
    return id_and_text(docs).mapInPandas(_pack(limit), PIECE_COLUMNS)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
