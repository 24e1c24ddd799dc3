"""Readers and writers for points, reports and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayscore import schemas
from wayscore.operators.ranking import store_ordered
from wayscore.session import store


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType = schemas.GPS_POINTS
) -> DataFrame:
    """CSV with a header. No inference pass; a header in another order is an error.

    A field that does not parse becomes NULL, and blank lines are skipped.
    """
    return spark.read.schema(schema).csv(
        path, header=True, mode="PERMISSIVE", enforceSchema=False
    )


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """With ``schema`` the file must hold those columns with those types."""
    if schema is None:
        return spark.read.parquet(path)
    found = spark.read.parquet(path)
    require_schema(found.schema, schema, path)
    return found.select(*schema.fieldNames())


def require_schema(found: T.StructType, wanted: T.StructType, path: str) -> None:
    """Raise if a wanted column is missing or has another type."""
    types = {f.name: f.dataType for f in found.fields}
    wrong = [
        f"{f.name}: {types[f.name].simpleString() if f.name in types else 'missing'}"
        for f in wanted.fields
        if f.name not in types or types[f.name] != f.dataType
    ]
    if wrong:
        raise ValueError(f"{path} does not hold the wanted columns: {', '.join(wrong)}")


def read_json(
    spark: SparkSession, path: str, schema: T.StructType, records: bool = False
) -> DataFrame:
    """JSON lines, or with ``records`` files that each hold one array of objects.

    Array files are read in parallel, each by one task. A record that does not
    parse stops the job.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", records)
    return reader.json(path, multiLine=records, mode="FAILFAST")


def read_first_available(
    spark: SparkSession, choices: Sequence[tuple[str, str]], schema: T.StructType
) -> DataFrame:
    """The first of ``[(format, path)]`` that exists and can be opened.

    Formats are those of Spark, and ``json array`` for files that each hold
    one array. Raises if none can be opened; made-up rows never replace
    missing data.
    """
    failures = []
    for fmt, path in choices:
        try:
            reader = spark.read.schema(schema)
            if fmt == "parquet":
                # Reading one footer finds a damaged file before the job starts.
                return read_parquet(spark, path, schema)
            if fmt == "json array":
                return read_json(spark, path, schema, records=True)
            return reader.format(fmt).load(path)
        except Exception as failure:
            if not _unreadable(failure):
                raise
            failures.append(f"{fmt} {path}: {type(failure).__name__}")
    raise FileNotFoundError("no source available: " + "; ".join(failures))


def _unreadable(failure: Exception) -> bool:
    missing = isinstance(failure, AnalysisException)
    return missing or "CANNOT_READ_FILE" in str(failure) or "FAILED_READ_FILE" in str(failure)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, non-ASCII text kept, one file per task."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_json_array(df: DataFrame, path: str, *order: Column) -> None:
    """JSON arrays in ``order``: every part folder holds one complete array.

    The folders follow each other in the order, and any JSON reader can read each
    of them; ``read_json`` with ``records`` reads them in parallel.
    """
    ordered = store_ordered(df, "json-rows", *order)
    ends = ordered.groupBy("part").agg(
        F.min("row_mark").alias("first_mark"), F.max("row_mark").alias("last_mark")
    )
    ends = store(ends, "json-ends")
    if ends.isEmpty():
        empty = df.sparkSession.createDataFrame([("[]",)], "value string")
        empty.coalesce(1).write.mode("overwrite").text(path)
        return
    line = F.concat(
        F.when(F.col("row_mark") == F.col("first_mark"), "[").otherwise(","),
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}),
        F.when(F.col("row_mark") == F.col("last_mark"), "]").otherwise(""),
    )
    lines = ordered.join(ends, "part").select("part", "row_mark", line.alias("value"))
    # One task writes a part as a whole, in its order.
    split = lines.repartition("part").sortWithinPartitions("part", "row_mark")
    split.select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def report_status(spark: SparkSession, path: str) -> DataFrame:
    """Whether a report exists, when it last changed, and its file names.

    Lists the files; their contents are not read.
    """
    empty = "data_ready boolean, last_update timestamp, source string"
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return spark.createDataFrame([(False, None, path)], empty)
    return files.agg(
        (F.count(F.lit(1)) > 0).alias("data_ready"),
        F.max("modificationTime").alias("last_update"),
        F.lit(path).alias("source"),
    )
