"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding undoes disguises: look-alike letters of other scripts, accents, full-width forms and digits
or signs that stand for letters. The lexicon holds whole words and word beginnings with log-odds
weights, learned from a bounded sample of labelled documents on top of a few seed words. Hits inside
an exception phrase do not count. The sum of the weights and the sum per length give a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, held_out, id_and_text, labelled_sample, prepare_workers, remainder, table

# Letters of other scripts by the Latin letter they look like.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһӏьвкмнтαοερτυικνχ", "aeopcyxijsdhlbbkmhtaoeptuiknx"
)
# Digits and signs by the letter they stand for inside a word; 1 is read in two ways.
SUBSTITUTES = bytes.maketrans(b"013456789@$!", b"oieasgtbgasi")
SUBSTITUTES_L = bytes.maketrans(b"013456789@$!", b"oleasgtbgasi")
SEEDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "clown fish", "pond scum")

_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_SIGNS = b"0123456789@$!"
# A whole run of letters, digits and signs that has both.
_DISGUISED = re.compile(rb"(?<![a-z0-9@$!])(?=[a-z]*[0-9@$!])(?=[0-9@$!]*[a-z])[a-z0-9@$!]+")
PREFIXES = range(4, 8)
FLUSH = 100_000  # terms a worker counts before it passes them on


CACHED_RUN = 40  # characters; longer runs, such as encoded data, are not kept


def _readings(run: bytes) -> list[bytes]:
    """What a run may say, the likeliest first: signs around a word may be part of it or not, and 1 may be
    i or l."""
    tail, whole = run.rstrip(_SIGNS), run.rstrip(b"!")
    forms = (tail, whole, tail.lstrip(_SIGNS))
    return list(dict.fromkeys(f.translate(t) for t in (SUBSTITUTES, SUBSTITUTES_L) for f in forms))


_kept_readings = lru_cache(maxsize=10_000)(_readings)


def read(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of a text in plain lower-case letters, disguises undone, and the disguised words' other readings."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.lower().translate(LOOKALIKES))
    raw = text.encode("ascii", "ignore").lower()
    others: list[bytes] = []

    def undo(run: re.Match) -> bytes:
        first, *more = (_kept_readings if len(run[0]) <= CACHED_RUN else _readings)(run[0])
        others.extend(more)
        return first

    raw = _DISGUISED.sub(undo, raw)
    return raw.translate(_LETTERS).split(), b" ".join(others).translate(_LETTERS).split()


def fold(text: str) -> list[bytes]:
    return read(text)[0]


def terms_of(words: list[bytes]) -> set[bytes]:
    """Patterns a text offers: whole words `` w `` and word beginnings `` w``."""
    distinct = set(words)
    found = {b" %s " % w for w in distinct}
    for n in PREFIXES:
        found.update(b" " + w[:n] for w in distinct if len(w) > n)
    return found


def group_mark(words: list[bytes]) -> int:
    """One min-hash over word triples: near copies mostly share it."""
    if len(words) < 3:
        return zlib.crc32(b" ".join(words))
    return min(map(zlib.crc32, map(b" ".join, zip(words, words[1:], words[2:], strict=False))))


@dataclass
class Lexicon:
    """Patterns with weights, exception phrases, and the three numbers of the final logistic."""

    weights: dict[bytes, float]
    exceptions: tuple[bytes, ...] = ()
    logistic: tuple[float, float, float] = (-3.0, 1.5, 1.0)
    _search: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_search": None}

    def search(self):
        if self._search is None:
            search = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                search.add_word(term.decode(), (len(term), weight))
            for phrase in self.exceptions:
                search.add_word(f" {phrase.decode()} ", (len(phrase) + 2, None))
            search.make_automaton()
            self._search = search
        return self._search

    def hits(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(start, end, weight) in the joined words, without those inside an exception phrase."""
        search = self.search()
        if not words or not len(search):
            return []
        line = f" {b' '.join(words).decode()} "
        found, excused = [], []
        for last, (size, weight) in search.iter(line):
            (excused if weight is None else found).append((last + 1 - size, last + 1, weight))
        if not excused:
            return found
        at, kept = 0, []
        excused.sort()
        for start, end, weight in sorted(found):
            while at < len(excused) and excused[at][1] < end:
                at += 1
            if at == len(excused) or excused[at][0] > start:
                kept.append((start, end, weight))
        return kept

    def evidence(self, text: str) -> tuple[float, int]:
        """The sum of the weights, over all readings of disguised words, and the number of words."""
        words, others = read(text)
        return sum(weight for _, _, weight in self.hits(words + others)), len(words)

    def score(self, text: str) -> float:
        total, words = self.evidence(text)
        z = float(np.dot(self.logistic, evidence_features(total, words)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def evidence_features(total: float, words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(total), math.log1p(100.0 * total / (words + 20.0))


def _counted(counts: Counter[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"term": list(counts), "n": list(counts.values())}).astype({"n": "float64"})


def _count_terms(wanted: frozenset[bytes] | None):
    """Weighted document counts of terms; ``wanted`` restricts them."""

    @frugal
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text, share in zip(batch["text"], batch["share"], strict=True):
                words, others = read(text)
                terms = terms_of(words + others)
                for term in terms if wanted is None else terms & wanted:
                    counts[term] += share
                if len(counts) >= FLUSH:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return count


@frugal
def _marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([group_mark(fold(t)) for t in texts], dtype="int64")


def _select(counts: dict[bytes, tuple[float, float]], toxic: float, clean: float, evidence: float):
    """Terms that mark toxic texts, each with its log-odds weight."""
    weights: dict[bytes, float] = {}
    support: dict[bytes, float] = {}
    rate = toxic / (toxic + clean)
    for term, (t, c) in counts.items():
        n = t + c
        if t / n <= rate:
            continue
        gain = t * math.log(t / (n * rate)) + (c * math.log(c / (n * (1 - rate))) if c else 0.0)
        weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        if gain >= evidence and weight >= 2.0:
            weights[term], support[term] = weight, t
    words = [t for t in weights if t.endswith(b" ")]
    kept: list[bytes] = []
    for prefix in sorted((t for t in weights if not t.endswith(b" ")), key=lambda t: (len(t), t)):
        if any(prefix.startswith(k) for k in kept):
            continue
        longer = max((support[t] for t in weights if len(t) == len(prefix) + 1 and t.startswith(prefix)), default=0)
        word = max((support[t] for t in words if t.startswith(prefix)), default=0)
        if longer < 0.9 * support[prefix] and support[prefix] >= 1.3 * word:
            kept.append(prefix)
    words = [w for w in words if not any(w.startswith(k) for k in kept)]
    return {t: weights[t] for t in kept + words}


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    w = np.array([-3.0, 1.0, 0.5])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.array([1e-3, 0.05, 0.05])
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w
        )
        w = w - step
        if abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(
    sample: DataFrame, evidence: float = 11.0, max_terms: int = 20_000, max_lexicon: int = 2_000
) -> Lexicon:
    """A lexicon from a bounded stored sample with ``text`` and ``label`` (0 or 1).

    Near copies share one vote: a document counts 1 / (documents with its mark). Terms need
    ``evidence`` (nats) against chance. ``max_terms`` bounds the candidates counted in clean texts,
    ``max_lexicon`` the lexicon; both take the best supported ones. Without positive or negative
    rows the lexicon is the seed words.
    """
    spark = sample.sparkSession
    prepare_workers(spark)
    seeds = {b" %s " % s.encode(): 3.0 for s in SEEDS}
    exceptions = tuple(e.encode() for e in EXCEPTIONS)
    marked = sample.select(
        "label", "text", F.pandas_udf(_marks, "long")(F.col("text")).alias("mark")
    )
    sizes = marked.groupBy("mark", "label").agg((1 / F.count("*")).alias("share"))
    # At most one row per sample document, whose number is bounded.
    shared = marked.join(F.broadcast(sizes), ["mark", "label"]).select("label", "text", "share")
    totals = {r["label"]: r["n"] for r in sizes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return Lexicon(seeds, exceptions)

    def counts(label: int, wanted: frozenset[bytes] | None) -> DataFrame:
        part = shared.where(F.col("label") == label).select("text", "share")
        return part.mapInPandas(_count_terms(wanted), "term binary, n double").groupBy("term").agg(F.sum("n").alias("n"))

    toxic = {
        bytes(r["term"]): r["n"]
        for r in counts(1, None).where("n >= 2.5").orderBy(F.desc("n"), "term").limit(max_terms).collect()
    }
    clean = {bytes(r["term"]): r["n"] for r in counts(0, frozenset(toxic)).collect()}
    joint = {t: (n, clean.get(t, 0.0)) for t, n in toxic.items()}
    learned = _select(joint, totals[1], totals[0], evidence)
    learned = dict(sorted(learned.items(), key=lambda x: (-x[1] * joint[x[0]][0], x[0]))[:max_lexicon])
    doubtful = {t for t in seeds if clean.get(t, 0.0) > toxic.get(t, 0.0)}
    lexicon = Lexicon({t: w for t, w in seeds.items() if t not in doubtful} | learned, exceptions)
    lexicon.exceptions += _learn_exceptions(sample, lexicon)
    rows = np.array(
        [
            (*evidence_features(r["total"], r["words"]), r["label"])
            for r in sample.select("label", evidence_udf(lexicon)(F.col("text")).alias("e"))
            .select("label", "e.total", "e.words")
            .collect()
        ]
    )
    lexicon.logistic = _fit_logistic(rows[:, :3], rows[:, 3])
    return lexicon


def _learn_exceptions(sample: DataFrame, lexicon: Lexicon, least: int = 5) -> tuple[bytes, ...]:
    """Word pairs around a hit that are common in clean sample texts and absent from toxic ones."""

    @frugal
    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter[tuple[bytes, int]] = Counter()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = fold(text)
                line, here = b" " + b" ".join(words) + b" ", set()
                for start, end, _ in lexicon.hits(words):
                    left = line.rfind(b" ", 0, max(start, 0)) + 1
                    word_end = line.find(b" ", start + 1)
                    right = line.find(b" ", word_end + 1)
                    if start > 0:
                        here.add(line[left:word_end])
                    if right > 0:
                        here.add(line[start + 1 : right])
                found.update((p, label) for p in here)
            yield pd.DataFrame(
                {"pair": [p for p, _ in found], "label": [y for _, y in found], "n": list(found.values())},
            ).astype({"label": "int64", "n": "int64"})

    counted = sample.select("text", "label").mapInPandas(pairs, "pair binary, label long, n long")
    summed = counted.groupBy("pair").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"),
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
    )
    rows = summed.where(f"clean >= {least} AND toxic = 0").orderBy(F.desc("clean"), "pair").limit(1000).collect()
    return tuple(bytes(r["pair"]) for r in rows if b" " in bytes(r["pair"]).strip())


def evidence_udf(lexicon: Lexicon):
    @frugal
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([lexicon.evidence(t) for t in texts], columns=["total", "words"]).astype(
                {"total": "float64", "words": "int64"}
            )

    return F.pandas_udf(weigh, "total double, words long")


def score_column(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text, 0 to 1; NULL counts as empty."""

    @frugal
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([lexicon.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")(F.coalesce(text, F.lit("")))


def train_on(
    docs: DataFrame, labels: DataFrame, max_positive: int = 5_000, max_negative: int = 25_000
) -> Lexicon:
    """Learn from labelled rows outside the hold-out (crc32 of the id modulo 4 is 2)."""
    learnable = lambda doc_id: remainder(doc_id, 4) != 2
    return train(labelled_sample(docs, labels, "toxic", learnable, max_positive, max_negative))


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, also repeated ones.

    A NULL or empty text has no evidence and gets the lowest score; a NULL id is not held out.
    """
    prepare_workers(docs.sparkSession)
    rows = id_and_text(docs).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), score_column(lexicon, F.col("text")).alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train_on(docs, table(spark, sf_dir, "labels")))
