"""How five document filters interact, in every order of applying them.

One pass gives each row a mask of the filters it fails; whether a smaller id has the same text is found
by tries over ranges of texts. The rows are then reduced to at most 32 masks per part, and all orders
and steps are read from those.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .text_tries import mark_copies

LEAST_WORDS = 200
LEAST_DISTINCT = 50  # per cent of the words
MOST_CAPITALS = 2  # per cent of the characters
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"  # few words, repeated words, capitals, symbols, copies; bit 0 is the first
COPY_BIT = 1 << FILTERS.index("E")

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_FOLLOWING = bytes(range(0x80, 0xC0))  # all bytes of a UTF-8 character but the first


def failures(text: bytes) -> int:
    """The mask of the filters that a text alone decides. ``bytes.split`` knows the six ASCII white spaces."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    characters = len(text.translate(None, _FOLLOWING))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * characters) << 2
        | symbols << 3
    )


def failure_masks(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, part, mask, n): the number of rows per id, source and mask of failed filters."""
    rows = mark_copies(docs, F.coalesce(F.col("source").cast("string"), F.lit("")), failures, **limits)
    mask = F.col("marks") + F.when(F.col("copy"), COPY_BIT).otherwise(0)
    return rows.groupBy("doc_id", F.col("tag").alias("part"), mask.alias("mask")).agg(F.sum("n").alias("n"))


def mask_counts(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """(part, mask, n, good, toxic): rows, and those whose id has the label quality 1 or toxic 1."""
    masks = failure_masks(docs, **limits)
    has = lambda name: F.max((F.coalesce(F.col(name).cast("int"), F.lit(0)) == 1).cast("int"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(has("quality").alias("quality"), has("toxic").alias("toxic"))
    count = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0))
    joined = masks.join(known, "doc_id", "left").groupBy("part", "mask")
    return joined.agg(F.sum("n").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def _steps() -> Column:
    """Every order and step: (filter_order, step, bit of its filter, bits of those before it)."""
    rows = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append({"filter_order": order, "step": step, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def audit(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """One row per part (source; NULL is ''), filter order and step, zeros included.

    A row of ``docs`` is a document, also a repeated one. NULL texts are empty. Without documents there
    are no rows. A document without an id has no label. Of an id with several labels any 1 counts.
    """
    entry = F.struct("mask", "n", "good", "toxic")
    parts = mask_counts(docs, labels, **limits).groupBy("part").agg(F.collect_list(entry).alias("masks"))  # 32 at most
    rows = parts.select("part", "masks", F.explode(_steps()).alias("s")).select("part", "masks", "s.*")

    def total(what: str, where) -> Column:
        zero = F.lit(0).cast("long")
        return F.aggregate("masks", zero, lambda sum_, m: sum_ + F.when(where(m["mask"]), m[what]).otherwise(zero))

    bit, before = F.col("bit"), F.col("before")
    fails = lambda mask: mask.bitwiseAND(bit) != 0
    gone = lambda mask: mask.bitwiseAND(before) != 0
    removed = lambda mask: fails(mask) & ~gone(mask)
    # A document that fails k filters is removed by each of them in 1 / k of the orders.
    orders = factorial(len(FILTERS))
    share = F.aggregate(
        "masks", F.lit(0).cast("long"),
        lambda sum_, m: sum_ + F.when(fails(m["mask"]), m["n"] * (orders / F.bit_count(m["mask"])).cast("long")).otherwise(F.lit(0)),
    )
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda mask: ~fails(mask) & ~gone(mask)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda mask: fails(mask) & gone(mask)).alias("redundant"),
        total("n", lambda mask: mask == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
