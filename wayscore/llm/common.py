"""Reading, hold-out splits and labelled samples shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, store

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH_ROWS = 1_000


def prepare_workers(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches at ``BATCH_ROWS`` or the session's own smaller number.

    A worker holds a batch of whole texts at a time, so the batch decides how much memory it takes.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def frugal(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches, then freed memory given back: the worker lives on for other stages."""

    @wraps(work)
    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only (doc_id, text), so that no other column can clash; a NULL text is empty."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def remainder(column: Column, divisor: int) -> Column:
    """``crc32`` of the value as text, modulo ``divisor``; NULL for NULL."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def held_out(column: Column, divisor: int, rest: int) -> Column:
    """Whether the remainder is ``rest``; false for a NULL id."""
    return F.coalesce(remainder(column, divisor) == rest, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    learnable: Callable[[Column], Column],
    max_positive: int,
    max_negative: int,
) -> DataFrame:
    """(doc_id, text, label) of at most that many labelled documents per class, stored.

    ``learnable`` says of an id whether it may be learned from. The rows with the smallest hash
    of their id are taken, so the sample is the same on every run. Its ids are broadcast: their
    number is bounded by the two limits. Of the rows of a repeated id the smallest text is taken.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learnable(F.col("doc_id"))
    )

    def first(value: int, n: int) -> DataFrame:
        rows = known.where(F.col("label") == value).groupBy("doc_id").agg(F.max("label").alias("label"))
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    ids = store(first(1, max_positive).union(first(0, max_negative)), "labelled-ids")
    chosen = id_and_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    chosen = chosen.select("doc_id", "text", "label")
    return store(chosen, "labelled-texts")
