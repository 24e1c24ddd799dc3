"""Language-model scores from a weighted backoff automaton.

Tokens are words in ASCII lower case and one end per text. Every n-gram of up to three tokens of the
training texts, also one that occurs once, is an arc of the automaton; every one that another token
follows is a state too. The arc of a token from a history h has the weight of

    p(token | h) = (count of both + prior * p(token | shorter h)) / (count of h + prior),

and the failure arc of h to its shorter history that of prior / (count of h + prior), so what has no
arc at h costs the failure arc and then what it costs there. The empty history is the root, whose arcs
are the words' own probabilities.

Texts are numbered into chunks of bounded size. A chunk sends the n-grams that it holds, as sorted
hashes with their counts, to buckets by hash; a bucket adds them up and answers each chunk with the
sums. So a chunk is given the part of the automaton that its texts can reach, and reads them with it.
What moves is a few bytes per token, and no task holds more than a chunk or a bucket of some chunks:
where there are many, what they ask is added up in levels.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .common import frugal, held_out, id_and_text, prepare_workers, table

END = b""
START = b"\n"  # white space, so never a word
ADDED = 0.1  # added to every count of a word
PRIORS = (200.0, 5.0)  # of pairs and of triples, in occurrences of the history
SIZES = (1, 2, 3)
CHUNK_TOKENS = 2_000_000
BUCKET_TOKENS = 1_000_000  # tokens of all chunks for each bucket
BUCKET_CHUNKS = 4_000  # chunks that a task adds up at once, about
SPARE_BITS = 20  # one n-gram in 2^20 may share its hash with another; words have 64 bits

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str) -> list[bytes]:
    """Lower-case words and the end. ``bytes`` methods know ASCII letters and white space only."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def after(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a history with one more token."""
    x = history * _K1 + word
    x ^= x >> np.uint64(31)
    x *= _K2
    return x ^ (x >> np.uint64(29))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, as many as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + planes.T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_CHUNK = (
    "chunk long, doc_id array<long>, held_out array<boolean>, learn array<boolean>, score boolean, "
    "sizes array<long>, words binary, codes binary, tokens long"
)
_CHUNK_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("learn", pa.list_(pa.bool_())),
    ("score", pa.bool_()), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("codes", pa.binary()), ("tokens", pa.int64()),
])


def _number(score: bool, chunk_tokens: int):
    @frugal
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, codes, docs = _Numbers(), array("I"), []
        chunk = TaskContext.get().partitionId() << 33 | score

        def emit():
            # Common words get small numbers, which pack well.
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            ids, held, learn, sizes = (list(x) for x in zip(*docs, strict=True))
            row = [
                chunk, ids, held, learn, score, sizes, hashes_of(list(words))[order].tobytes(),
                pack(rank[np.frombuffer(codes, np.uint32)]), len(codes),
            ]
            columns = [pa.array([x], f.type) for x, f in zip(row, _CHUNK_SCHEMA, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=_CHUNK_SCHEMA)

        for batch in batches:
            for doc_id, text, held, learn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = tokens(text)
                codes.extend(map(words.__getitem__, found))
                docs.append((doc_id, held, learn, len(found)))
                if len(codes) >= chunk_tokens:
                    yield emit()
                    words, codes, docs, chunk = _Numbers(), array("I"), [], chunk + 2
        if docs:
            yield emit()

    return number


@dataclass
class Chunk:
    """The texts of a chunk one behind the other. ``first`` says where they begin."""

    words: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray
    learn: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        sizes = np.array(row["sizes"], np.int64)
        learn = np.repeat(np.array(row["learn"], bool), sizes)
        return cls(np.frombuffer(row["words"], np.uint64), unpack(row["codes"]).astype(np.int64), sizes, learn)

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def keys(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For words, pairs and triples: a key of the n-gram that ends at each place, and these places.

        A text's first pair and triple begin with ``START``; at its first place no triple ends.
        """
        word, cut = self.words[self.codes], np.uint64(64 - bits)
        yield word, np.arange(len(word))
        before = np.roll(word, 1)
        before[self.first] = hashes_of([START])[0]
        pair = after(before, word)
        yield pair >> cut, np.arange(len(word))
        inner = np.ones(len(word), bool)
        inner[self.first] = False
        places = np.flatnonzero(inner)
        yield after(pair[places - 1], word[places]) >> cut, places


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and for each key its number among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number


def _keys_out(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and the steps between them."""
    return keys[:1].tobytes() + pack(np.diff(keys))


def _keys_in(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, np.uint64, 1)
    return np.cumsum(np.concatenate([first, unpack(data[8:])]), dtype=np.uint64)


_ASKED = "size int, bucket long, chunk long, score boolean, keys binary, counts binary"
_ASKED_SCHEMA = pa.schema([
    ("size", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("score", pa.bool_()),
    ("keys", pa.binary()), ("counts", pa.binary()),
])


def _cut(keys: np.ndarray, counts: np.ndarray, wide: int, bucket_bits: int) -> list[tuple[int, bytes, bytes]]:
    """Sorted keys of ``wide`` bits by bucket, which is their first bits: (bucket, keys, counts)."""
    bucket = (keys >> np.uint64(wide - bucket_bits) if bucket_bits else keys * np.uint64(0)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 62))
    return [(int(bucket[a]), _keys_out(keys[a:b]), pack(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _ask(bits: int, bucket_bits: int):
    @frugal
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row)
                for size, (keys, places) in zip(SIZES, chunk.keys(bits), strict=True):
                    found, number = distinct(keys)
                    counts = np.bincount(number, chunk.learn[places], minlength=len(found)).astype(np.uint64)
                    parts = _cut(found, counts, 64 if size == 1 else bits, bucket_bits)
                    rows = [(size, bucket, row["chunk"], row["score"], *rest) for bucket, *rest in parts]
                    if rows:
                        columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ASKED_SCHEMA, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, schema=_ASKED_SCHEMA)

    return ask


_ANSWER = "chunk long, size int, bucket long, counts binary, different long, total long"
_ANSWER_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("size", pa.int32()), ("bucket", pa.int64()), ("counts", pa.binary()),
    ("different", pa.int64()), ("total", pa.int64()),
])


def _together(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of some rows of a bucket, their summed counts, and where among them each row's keys are."""
    keys = [_keys_in(r["keys"]) for r in rows]
    found, number = distinct(np.concatenate(keys))
    counts = np.concatenate([unpack(r["counts"]) for r in rows])
    sums = np.bincount(number, counts).astype(np.uint64)  # whole numbers below 2^53
    return found, sums, np.split(number, np.cumsum([len(k) for k in keys])[:-1])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _told(rows: list[dict], sums: np.ndarray, numbers: list[np.ndarray]) -> list[tuple]:
    """For each row that is to be answered its sums, in the order of its keys."""
    return [
        (row["chunk"], row["size"], row["bucket"], pack(sums[number]), None, None)
        for row, number in zip(rows, numbers, strict=True)
        if row["score"]
    ]


def _answer(asked: pa.Table) -> pa.Table:
    """Sums of one bucket, for each chunk in the order of its keys; and a row with no chunk about them all."""
    rows = asked.to_pylist()
    _, sums, numbers = _together(rows)
    about = (None, rows[0]["size"], rows[0]["bucket"], None, int((sums > 0).sum()), int(sums.sum()))
    return _table([about, *_told(rows, sums, numbers)], _ANSWER_SCHEMA)


def _add_up(bits: int, bucket_bits: int):
    """What some chunks ask of a bucket as one chunk would, named by their number, in buckets of the level above."""

    def add_up(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        found, sums, _ = _together(rows)
        size, part, score = rows[0]["size"], rows[0]["part"], any(r["score"] for r in rows)
        parts = _cut(found, sums, 64 if size == 1 else bits, bucket_bits)
        return _table([(size, bucket, part, score, *rest) for bucket, *rest in parts], _ASKED_SCHEMA)

    return add_up


def _hand_down(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to what ``_add_up`` asked, dealt out to its chunks; none if no chunk is to be answered."""
    told = sorted(answers.select(["above", "counts"]).to_pylist(), key=lambda a: a["above"])
    rows = asked.to_pylist()
    if not told:
        return _table([], _ANSWER_SCHEMA)
    return _table(_told(rows, np.concatenate([unpack(a["counts"]) for a in told]), _together(rows)[2]), _ANSWER_SCHEMA)


def levels(chunks: int, tokens: int, bits: int, bucket_tokens: int, most: int) -> list[tuple[int, int]]:
    """From the chunks up: into how many parts they are added up, and bits of a bucket's number. The last is (1, bits).

    A bucket of a part holds about ``bucket_tokens``, so a chunk's share of a bucket stays large at any size.
    """
    out = []
    while not out or out[-1][0] > 1:
        left = out[-1][0] if out else chunks
        parts = 1 if left <= most else math.ceil(left / most)
        out.append((parts, min(bits, max(0, math.ceil(math.log2(max(1, tokens) / parts / bucket_tokens))))))
    return out


def answers_of(asked: DataFrame, plan: list[tuple[int, int]], bits: int) -> DataFrame:
    """``_answer`` for every bucket, stored. A common n-gram is asked by every chunk, so many chunks are added
    up in parts first, level by level, and the answers are handed down again."""
    (parts, bucket_bits), *higher = plan
    if not higher:
        return _packed(asked.groupBy("size", "bucket").applyInArrow(_answer, _ANSWER), "n-gram-counts")
    parted = _packed(asked, "n-grams-asked").withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts).cast("long")))
    groups = parted.groupBy("size", "bucket", "part")
    finer = higher[0][1]
    above = answers_of(groups.applyInArrow(_add_up(bits, finer), _ASKED), higher, bits)
    told = above.where("chunk IS NOT NULL").withColumnRenamed("bucket", "above")
    told = told.withColumn("bucket", F.shiftright("above", finer - bucket_bits)).groupBy("size", "bucket", "chunk")
    below = groups.cogroup(told).applyInArrow(_hand_down, _ANSWER)
    return _packed(below.unionByName(above.where("chunk IS NULL")), "n-gram-counts")


def smoothed(count: np.ndarray, history: np.ndarray, lower: np.ndarray, prior: float) -> np.ndarray:
    """Weight of the arc of an n-gram; at count 0 it is the failure arc's, prior / (history + prior), times
    what the token weighs from there, and at an unknown history the failure arc weighs 1."""
    return (count + prior * lower) / (history + prior)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _read(total: int, distinct_words: int, bits: int, priors: tuple[float, float]):
    """All texts of a chunk, from left to right at once.

    The state after a place is the longest history there that the automaton has. With an n-gram it
    has all shorter ends of it, so the state only depends on the last two tokens, not on the way.
    """

    def read(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunks.to_pylist()[0]
        chunk = Chunk.of(row)
        told: dict[int, list] = {size: [] for size in SIZES}
        for a in sorted(answers.select(["size", "bucket", "counts"]).to_pylist(), key=lambda a: a["bucket"]):
            told[a["size"]].append(unpack(a["counts"]))
        counts = []
        for size, (keys, places) in zip(SIZES, chunk.keys(bits), strict=True):
            here = np.zeros(len(chunk.codes))
            if len(places):
                here[places] = np.concatenate(told[size]).astype(np.float64)[distinct(keys)[1]]
            counts.append(here)
        word, pair, triple = counts
        first = chunk.first
        history, two = np.roll(word, 1), np.roll(pair, 1)
        history[first], two[first] = word[-1], 0  # training texts have as many starts as ends
        p = base = (word + ADDED) / (total + ADDED * (distinct_words + 1))
        for count, before, prior in ((pair, history, priors[0]), (triple, two, priors[1])):
            p = smoothed(count, before, p, prior)
        add = lambda x: pa.array(np.add.reduceat(x, first))
        columns = [
            pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(chunk.sizes),
            add((word > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(p)),
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in _SCORED.split(", ")])

    return read


def _packed(df: DataFrame, name: str) -> DataFrame:
    """As ``store``, for bytes that are worth a better codec."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks_of(rows: DataFrame, score: bool, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The texts of ``rows`` (doc_id, text, held_out, learn) as numbered chunks, stored."""
    prepare_workers(rows.sparkSession)
    chosen = rows.select("doc_id", "text", "held_out", "learn")
    return _packed(chosen.mapInArrow(_number(score, chunk_tokens), _CHUNK), "text-chunks")


def read_chunks(
    chunks: DataFrame, priors: tuple[float, float] = PRIORS, bucket_tokens: int = BUCKET_TOKENS, most: int = BUCKET_CHUNKS
) -> DataFrame:
    """Learn from the texts to be learned from, score those to be scored."""
    about = chunks.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("chunks")).first()
    placed = about["tokens"] or 0
    bits = min(64, SPARE_BITS + max(1, placed).bit_length())
    plan = levels(about["chunks"], placed, bits, bucket_tokens, most)
    answers = answers_of(chunks.mapInArrow(_ask(bits, plan[0][1]), _ASKED), plan, bits)
    known = answers.where("chunk IS NULL AND size = 1").agg(F.sum("different").alias("different"), F.sum("total").alias("total")).first()
    total, different = known["total"] or 0, known["different"] or 0
    read = _read(total, different, bits, priors)
    own = chunks.where("score").groupBy("chunk")
    scored = own.cogroup(answers.where("chunk IS NOT NULL").groupBy("chunk")).applyInArrow(read, _SCORED)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _rows(docs: DataFrame, held: Column, learn: Column) -> DataFrame:
    return id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), learn.alias("learn"))


@dataclass
class Model:
    """The training texts as chunks; the automaton's counts are gathered where texts are scored."""

    chunks: DataFrame
    priors: tuple[float, float]


def train(texts: DataFrame, priors: tuple[float, float] = PRIORS, chunk_tokens: int = CHUNK_TOKENS) -> Model:
    """A model of all rows of ``texts`` (column ``text``; NULL is an empty text).

    Without texts every word has probability 1, as the base formula says.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = texts.select(F.lit(None).cast("long").alias("doc_id"), text, F.lit(False).alias("held_out"), F.lit(True).alias("learn"))
    return Model(chunks_of(rows, False, chunk_tokens), priors)


def score_documents(docs: DataFrame, model: Model, divisor: int = 10, rest: int = 0, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Scores of every row, also repeated ones; a NULL or empty text is one end token."""
    rows = _rows(docs, held_out(F.col("doc_id"), divisor, rest), F.lit(False))
    return read_chunks(model.chunks.unionByName(chunks_of(rows, True, chunk_tokens)), model.priors)


def score_by_rest(docs: DataFrame, divisor: int = 10, rest: int = 0, priors: tuple[float, float] = PRIORS) -> DataFrame:
    """Learn from the rows that aren't held out, score all rows, in one go; a NULL id is not held out."""
    held = held_out(F.col("doc_id"), divisor, rest)
    return read_chunks(chunks_of(_rows(docs, held, ~held), True), priors)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from rows whose crc32 of the id modulo 10 is not 0, score all rows."""
    return score_by_rest(table(spark, sf_dir, "documents"))
