"""Secret scan in DataFrame expressions only.

Three fixed patterns give the base spans. On top, candidate strings are scanned with a sliding
window: the Shannon entropy of the window is kept up to date from incremental character counts, and
the characters of each class in it are counted along, so every window is judged by the limit of its
own class. A candidate is a span when any of its windows reaches its limit. The allow-list excuses
only the stretches it matches: no window that touches one is judged. Positions are code points: the pieces between the matches and the matches
themselves are measured and added up, as Spark gives no match offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, table

# The base patterns, in the order in which equal starts are listed. Java's (?i) folds
# ASCII letters only. Runs that are too short are left out by {n,}: they hide no other match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % WINDOW
# Window entropy in bits from which a window of a class counts; log2(20) is 4.32.
LIMITS = {"hex": 3.0, "mixed": 3.6}
# Stretches that are excused: a UUID, a run of filling or counting, a segment with a word that says so.
ALLOWED = (
    r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])",
    r"(?i)x{6,}|0{8,}|abcdefghij|0123456789",
    r"(?i)(?<![A-Z0-9])[A-Z0-9]*?(example|sample|dummy|placeholder|changeme)[A-Z0-9]*",
)
ALLOWED_BEFORE = r"(?i)(sha-?(1|256|512)|md5|commit|checksum|integrity|uuid)[\"']?[\s:=-]{0,3}$"

_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
_FOUND = "struct<start:bigint,end:bigint,text:string,inner:string,before:string>"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of all matches with code-point positions, one group and the 24 characters before."""
    rule = F.lit(pattern)
    pieces = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("piece"),
        F.regexp_extract_all(text, rule, F.lit(0)).alias("text"),
        F.regexp_extract_all(text, rule, F.lit(group)).alias("inner"),
    )

    def step(state: Column, part: Column) -> Column:
        piece, match = part.getField("piece"), part.getField("text")
        start = state.getField("at") + F.char_length(piece)
        end = start + F.char_length(match)
        found = F.struct(
            start.alias("start"), end.alias("end"), match.alias("text"),
            part.getField("inner").alias("inner"), F.right(piece, F.lit(24)).alias("before"),
        )
        return F.struct(end.alias("at"), F.concat(state.getField("found"), F.array(found)).alias("found"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), _empty(_FOUND).alias("found"))
    every = F.aggregate(parts, start, step, lambda s: s.getField("found"))
    return F.when(text.rlike(pattern), every).otherwise(_empty(_FOUND))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(
        found,
        lambda x: F.struct(
            x.getField("start").alias("start"), F.lit(rank).alias("rank"), x.getField("end").alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda x: F.concat_ws(":", x.getField("kind"), x.getField("start"), x.getField("end")),
        ),
        ",",
    )


def largest_entropies(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy in bits of any window of an ASCII string, 0 if there is none: ``hex``
    of windows of hex digits alone, ``mixed`` of the others. No window goes over a space.

    Each step adds one character and drops one: two counts change, and with them the running sum of
    n log2 n, from which the entropy is log2(window) - sum / window.
    """

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(F.greatest(n, F.lit(1)))).otherwise(F.lit(0.0))

    def scan(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            counts, total, hexes = state.getField("counts"), state.getField("total"), state.getField("hexes")
            new = F.get(codes, i)
            old = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            came, went = F.get(counts, new), F.coalesce(F.get(counts, old), F.lit(0))
            changed = (
                total + weight(came + 1) - weight(came)
                + F.when(old >= 0, weight(went - 1) - weight(went)).otherwise(F.lit(0.0))
            )
            next_total = F.when(new == old, total).otherwise(changed)
            next_counts = F.when(new == old, counts).otherwise(
                F.transform(
                    counts,
                    lambda n, at: n + F.when(at == new, 1).otherwise(0) - F.when(at == old, 1).otherwise(0),
                )
            )
            next_hexes = hexes + _is_hex(new) - _is_hex(old)
            spaces = F.get(counts, F.lit(32)) + F.when(new == 32, 1).otherwise(0) - F.when(old == 32, 1).otherwise(0)
            judged = (i >= window - 1) & (spaces == 0)
            entropy = math.log2(window) - next_total / window

            def best(kind: str, of_kind: Column) -> Column:
                return F.when(judged & of_kind, F.greatest(state.getField(kind), entropy)).otherwise(state.getField(kind))

            return F.struct(
                next_counts.alias("counts"), next_total.alias("total"), next_hexes.alias("hexes"),
                best("hex", next_hexes == window).alias("hex"), best("mixed", next_hexes < window).alias("mixed"),
            )

        start = F.struct(
            F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("hexes"),
            F.lit(0.0).alias("hex"), F.lit(0.0).alias("mixed"),
        )
        every = F.sequence(F.lit(0), F.size(codes) - 1)
        return F.aggregate(every, start, step, lambda s: F.struct(s.getField("hex"), s.getField("mixed")))

    codes = F.transform(F.regexp_extract_all(text, F.lit("."), F.lit(0)), lambda c: F.ascii(c))
    # As a lambda's argument the codes are computed once, not once per step.
    return F.get(F.transform(F.array(codes), scan), F.lit(0))


def largest_entropy(text: Column, window: int = WINDOW) -> Column:
    """The larger of the two, whatever the class."""
    best = largest_entropies(text, window)
    return F.greatest(best.getField("hex"), best.getField("mixed"))


def _is_hex(code: Column) -> Column:
    return F.when(code.between(48, 57) | code.between(65, 70) | code.between(97, 102), 1).otherwise(0)


def _is_secret(found: Column, window: int, limits: dict[str, float]) -> Column:
    text = found.getField("text")
    for allowed in ALLOWED:
        text = F.regexp_replace(text, allowed, " ")
    judged = text.rlike("[^ ]{%d}" % window) & ~found.getField("before").rlike(ALLOWED_BEFORE)
    # As a lambda's argument the entropies are computed once, not once per class.
    over = F.exists(
        F.array(largest_entropies(text, window)),
        lambda x: (x.getField("hex") >= limits["hex"]) | (x.getField("mixed") >= limits["mixed"]),
    )
    return F.when(judged, over).otherwise(F.lit(False))


def find_secrets(docs: DataFrame, window: int = WINDOW, limits: dict[str, float] | None = None) -> DataFrame:
    """doc_id, the base spans' counts and digest, and all spans, for every row, also repeated ones.

    A span is kind:start:end over the whole match. The counts and the digest are of base spans; the
    method's spans are listed as ``entropy`` unless a base span covers the same candidate. A NULL or
    empty text has no span: its digest is that of the empty string.
    """
    text = F.col("text")
    long_enough = lambda x: F.char_length(x.getField("inner")) >= MIN_ASSIGNED
    found = id_and_text(docs).select(
        "doc_id",
        _spans(F.filter(located(text, ASSIGN, 2), long_enough), "assign", 0).alias("assign"),
        _spans(located(text, ACCESS), "access", 1).alias("access"),
        _spans(located(text, HEX), "hex", 2).alias("hex"),
        _spans(
            F.filter(located(text, CANDIDATE), lambda x: _is_secret(x, window, limits or LIMITS)), "entropy", 3
        ).alias("entropy"),
    )
    joined = found.select(
        "doc_id", "assign", "access", "hex", F.concat("assign", "access", "hex").alias("base"), "entropy"
    )

    def new(span: Column) -> Column:
        return ~F.exists(
            F.col("base"),
            lambda b: (b.getField("start") <= span.getField("start")) & (b.getField("end") >= span.getField("end")),
        )

    return joined.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", F.filter("entropy", new))).alias("spans"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
