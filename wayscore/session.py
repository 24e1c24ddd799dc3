"""Session defaults and tables written to the shared folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lets "first n rows per city" be cut on the map side for n up to 10,000.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
}


def build_session(
    app_name: str = "wayscore", master: str | None = None, **settings: str
) -> SparkSession:
    """A session with the defaults above; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would not be seen by the other machines.
    """
    context = spark.sparkContext
    app = context.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return f"{named.rstrip('/')}/wayscore/{app}"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all machines share")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="wayscore-")
    return _local_folders[app]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        archive = f"{tempfile.mkdtemp(prefix='wayscore-')}/{package.name}"
        spark.sparkContext.addPyFile(
            shutil.make_archive(archive, "zip", package.parent, package.name)
        )
        _shipped.add(app)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table.

    Cuts the lineage: a lost executor re-reads files instead of repeating the
    work above, and later uses share one result. The files' size is known to
    the optimizer, so a small stored table is broadcast and a big one is not.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
