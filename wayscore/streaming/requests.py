"""Driver requests scored as they arrive, and the state of each request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wayscore import fixed, schemas
from wayscore.functions.decisions import risk_level
from wayscore.operators.scoring import score_by_rule


def by_rule(requests: DataFrame) -> DataFrame:
    return score_by_rule(requests, "speed")


def result_rows(
    requests: DataFrame, scorer: Callable[[DataFrame], DataFrame] = by_rule
) -> DataFrame:
    """One result per request; a request that fails gets an error row.

    Works the same on a batch and on a stream.
    """
    failed = F.col("error").isNotNull()
    return scorer(requests).select(
        "request_id",
        "driver_id",
        F.when(~failed, risk_level(F.col("sentiment"))).alias("risk_level"),
        F.when(~failed, F.round(F.coalesce("score", F.lit(0.0)), 4)).alias("ai_confidence"),
        "error",
        F.when(failed, fixed.FAILED).otherwise(fixed.SUCCESS).alias("status"),
    )


def submit(requests: DataFrame, path: str) -> None:
    """Add requests to the folder a stream reads; each write arrives as a whole."""
    columns = schemas.DRIVER_REQUESTS.fieldNames()
    requests.select(*columns).write.mode("append").parquet(path)


def open_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """A stream of the files that arrive in the folder, or match the glob, ``path``."""
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def start_scoring(
    requests: DataFrame,
    results: str,
    checkpoint: str,
    scorer: Callable[[DataFrame], DataFrame] = by_rule,
    continuous: bool = False,
) -> StreamingQuery:
    """Score ``requests`` into Parquet, each exactly once.

    Runs until all present files are done, or with ``continuous`` for as long
    as the query is left running. A restart goes on from ``checkpoint``.
    """
    writer = (
        result_rows(requests, scorer)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", results)
        .option("checkpointLocation", checkpoint)
    )
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def request_status(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Success or Failure of each request, or Pending if it has no result yet."""
    found = results.drop("driver_id")
    state = (
        F.when(F.col("status").isNull(), fixed.PENDING)
        .when(F.col("status") == fixed.FAILED, fixed.FAILURE)
        .otherwise(F.col("status"))
    )
    return requests.join(found, "request_id", "left").select(
        "request_id",
        "driver_id",
        state.alias("status"),
        "risk_level",
        "ai_confidence",
        "error",
    )
