"""Standardised features, K-means and cluster labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayscore import fixed
from wayscore.session import store


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_std") -> DataFrame:
    """Add each column with mean 0 and population deviation 1; constants give 0.

    Means and deviations are one row, read through a scalar subquery.
    """
    require_columns(df, columns)
    moments = [
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns
    ]
    stats = df.agg(F.struct(*moments)).scalar()

    def scaled(column: str) -> Column:
        mean, sd = F.col(f"_stats.{column}.mean"), F.col(f"_stats.{column}.sd")
        return F.when(sd > 0, (F.col(column) - mean) / sd).otherwise(0.0)

    with_stats = df.withColumn("_stats", stats)
    return with_stats.withColumns({f"{c}{suffix}": scaled(c) for c in columns}).drop("_stats")


def cluster(
    df: DataFrame,
    columns: Sequence[str] = fixed.DRIVER_FEATURES,
    k: int = fixed.CLUSTERS,
    seed: int = fixed.CLUSTER_SEED,
    max_iter: int = 300,
    tol: float = 1e-4,
    scale: bool = True,
    collapse: bool = False,
) -> DataFrame:
    """Add the K-means ``cluster`` of each row.

    The rows are stored first: the iterations, the final assignment and any
    executor that is lost on the way then start from files. With ``collapse``
    equal rows, such as all the stalls, are fitted as one row with a weight,
    which is the same problem over less data.
    """
    require_columns(df, columns)
    rows = store(df, "cluster-input")
    inputs = [f"{c}_std" for c in columns] if scale else list(columns)
    ready = standardise(rows, columns) if scale else rows
    assembler = VectorAssembler(inputCols=inputs, outputCol="vector")
    # The row solver also works when there are fewer different rows than clusters.
    means = KMeans(
        featuresCol="vector",
        predictionCol="cluster",
        k=k,
        seed=seed,
        maxIter=max_iter,
        tol=tol,
        solver="row",
    )
    if collapse:
        weighted = ready.groupBy(*inputs).agg(F.count(F.lit(1)).cast("double").alias("weight"))
        model = means.setWeightCol("weight").fit(assembler.transform(weighted))
    else:
        model = means.fit(assembler.transform(ready))
    return model.transform(assembler.transform(ready)).select(*df.columns, "cluster")


def cluster_means(df: DataFrame, value: str, by: str = "cluster") -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean_value"))


def lowest_and_highest(means: DataFrame, by: str = "cluster") -> DataFrame:
    """The groups of lowest and highest mean, the first of equals, in one row."""
    low = F.min(F.struct("mean_value", by))
    # The smallest negated mean belongs to the highest, lowest key first.
    high = F.min(F.struct((-F.col("mean_value")).alias("negated"), by))
    known = means.filter(F.col("mean_value").isNotNull() & ~F.isnan("mean_value"))
    return known.agg(low[by].alias("lowest"), high[by].alias("highest"))


def label_clusters(
    df: DataFrame,
    value: str = "average_speed",
    risk: str = fixed.LABEL_RISK,
    good: str = fixed.LABEL_GOOD,
    normal: str = fixed.LABEL_NORMAL,
) -> DataFrame:
    """Slowest cluster, fastest cluster and the rest; a lone cluster is good."""
    ends = lowest_and_highest(cluster_means(df, value)).select(F.struct("*")).scalar()
    label = (
        F.when(F.col("cluster") == F.col("_ends.highest"), good)
        .when(F.col("cluster") == F.col("_ends.lowest"), risk)
        .otherwise(normal)
    )
    return df.withColumn("_ends", ends).withColumn("label", label).drop("_ends")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)
