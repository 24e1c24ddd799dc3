"""Personal data: fixed patterns as base, and a BiLSTM-CRF tagger that adds spans.

The tagger learns once per session from labelled spans that are written into made-up text in many
formats, hard negatives included. An added span must hold a digit or an at-sign, so only regions
around those characters are decoded; everything else can hold no span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tagger
from .common import frugal, id_and_text, prepare_workers, table

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Look-behinds and possessive repeats only save time: a match can
# start inside a digit run only where the match before it ended, and none ends inside one.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANCHOR = re.compile(r"[0-9@]")
REACH = 48  # characters around a digit or at-sign that are decoded
SURE = 0.9  # least mean probability of an added span


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the fixed patterns, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _ANCHOR.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs, joined where they meet."""
    out: list[list[int]] = []
    for m in _ANCHOR.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _trim(text: str, start: int, end: int, kind: int) -> tuple[int, int]:
    keep = r"[A-Za-z0-9]" if kind == 0 else r"[0-9]"
    inside = [m.start() for m in re.finditer(keep, text[start:end])]
    if not inside:
        return start, start
    first, last = start + inside[0], start + inside[-1] + 1
    if kind == 3 and first > start and text[first - 1] in "+(":
        first -= 1
    return first, last


def _plausible(found: str, kind: int) -> bool:
    digits = len(_NOT_DIGIT.sub("", found))
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+\.[A-Za-z0-9-]+", found))
    if kind == 1:
        return bool(re.fullmatch(r"(?:[0-9]{1,3} ?\. ?){3}[0-9]{1,3}", found))
    if kind == 2:
        return 13 <= digits <= 19 and not re.search(r"[^0-9 .-]", found)
    return 9 <= digits <= 15 and not re.search(r"[^0-9 .()+/-]", found)


def added_spans(texts: list[str], base: list[list[tuple]], model: tagger.Tagger) -> list[list[tuple]]:
    """The tagger's spans that touch no base span, per text."""
    owners, parts = [], []
    out: list[list[tuple]] = [[] for _ in texts]
    size = 0

    def flush():
        nonlocal size
        for (k, start), (tag, chance) in zip(owners, model.tags(parts), strict=True):
            edges = np.flatnonzero(np.diff(tag)) + 1
            for a, b in zip([0, *edges], [*edges, len(tag)], strict=True):
                if not tag[a] or chance[a:b].mean() < SURE:
                    continue
                kind = int(tag[a]) - 1
                x, y = _trim(texts[k], start + int(a), start + int(b), kind)
                if _plausible(texts[k][x:y], kind) and not any(s < y and x < e for s, _, e in base[k]):
                    out[k].append((x, kind, y))
        owners.clear()
        parts.clear()
        size = 0

    for k, text in enumerate(texts):
        for start, end in regions(text):
            owners.append((k, start))
            parts.append(tagger.classes(text[start:end]))
            size += end - start
            if size > 100_000:
                flush()
    flush()
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# -- labelled spans ---------------------------------------------------------------------------


def labelled_windows(count: int = 3000, size: int = 64, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up text with labelled personal data and look-alikes: (classes, tags)."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[rng.integers(len(options))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 10)))

    def email() -> str:
        local = pick([word() + "." + digits(2), word(), word() + "_" + word(), word() + "+" + word()])
        gap = pick(["", "", "", " "])
        return f"{local}{gap}@{gap}{word()}{pick(['', digits(1)])}.{pick(['example.com', 'org', 'de', 'co.uk', word()[:3]])}"

    def ip() -> str:
        dot = pick([".", ".", ".", " . "])
        return dot.join(str(n) for n in rng.integers(0, 256, 4))

    def card() -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        gap = pick(["", "", " ", "-", "."])
        return gap.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}-{b}-{c}",
                     f"+{digits(2)} {a} {digits(7)}", f"0{digits(3)}/{digits(7)}", f"+{digits(11)}", f"{a}.{b}.{c}"])

    def other() -> str:
        return pick([digits(4), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(2)}.{digits(1)}", "@" + word(),
                     f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(3)},{digits(3)}", "#" + digits(6),
                     word() + digits(2), digits(8), f"{digits(2)}/{digits(2)}/{digits(4)}", digits(24), digits(12) + word(),
                     f"v{digits(1)}.{digits(1)}", word() + "=" + digits(5) + word() + digits(4) + word(), f"{digits(2)}%"])

    makers = (email, ip, card, phone)
    texts = np.zeros((count, size), np.int8)
    tags = np.zeros((count, size), np.int8)
    for row in range(count):
        line, tag = "", []
        while len(line) < 3 * size:
            choice = rng.random()
            if choice < 0.17:
                kind = int(rng.integers(4))
                piece, mark = makers[kind](), kind + 1
            elif choice < 0.32:
                piece, mark = other(), 0
            else:
                piece, mark = pick([word(), word().capitalize(), word() + ",", word() + "."]), 0
            line += piece
            tag += [mark] * len(piece)
            gap = pick([" ", " ", " ", " ", "\n", ", ", ". ", "### ", ": "])
            line += gap
            tag += [0] * len(gap)
        at = int(rng.integers(0, len(line) - size))
        texts[row], tags[row] = tagger.classes(line[at : at + size]), tag[at : at + size]
    return texts, tags


@lru_cache(maxsize=1)
def trained() -> tagger.Tagger:
    """The tagger, learned from generated labelled spans; the same on every run."""
    x, y = labelled_windows()
    return tagger.fit(x, y, len(KINDS) + 1)


# -- on documents -----------------------------------------------------------------------------


def _spans_of(texts: pd.Series, model: tagger.Tagger) -> Iterator[tuple[str, list, list]]:
    whole = list(texts)
    base = [base_spans(t) for t in whole]
    yield from zip(whole, base, added_spans(whole, base, model), strict=True)


def find_personal_data(docs: DataFrame, model: tagger.Tagger | None = None) -> DataFrame:
    """doc_id, the base spans' counts and digest, and all spans, for every row, also repeated ones.

    A span is kind:start:end in code points. A NULL or empty text has none: its digest is that of the
    empty string.
    """
    prepare_workers(docs.sparkSession)
    model = model or trained()

    @frugal
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for _, base, added in _spans_of(texts, model):
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(4)), digest, listed(base + added)))
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pd.DataFrame(rows, columns=names).astype({f"n_{k}": "int64" for k in KINDS})

    kind = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return id_and_text(docs).select("doc_id", F.pandas_udf(find, kind)(F.col("text")).alias("r")).select("doc_id", "r.*")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of touching or overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(text: Column, model: tagger.Tagger | None = None) -> Column:
    """The text without its personal data; NULL stays NULL."""
    model = model or trained()

    @frugal
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redact(t, base + added) for t, base, added in _spans_of(texts, model)], dtype="object")

    return F.when(text.isNotNull(), F.pandas_udf(clean, "string")(F.coalesce(text, F.lit(""))))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
