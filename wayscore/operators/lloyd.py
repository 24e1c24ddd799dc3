"""K-means from fixed starting centres: the same clusters on every run and in every engine.

``operators.clusters`` draws its starting centres at random, so its cluster numbers depend on the
engine. Here the start follows from the columns' means and deviations, rows go to the nearest centre
(the first of equals), and the centres move until they rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayscore import fixed
from wayscore.operators.clusters import require_columns, standardise
from wayscore.session import store

REST = 1e-9  # a centre that moves no further than this in every column rests


def starting_centres(k: int, columns: int) -> list[list[float]]:
    """``k`` points on the diagonal, from one deviation below the mean to one above, in deviations."""
    return [[0.0 if k == 1 else 2.0 * i / (k - 1) - 1.0] * columns for i in range(k)]


def place(df: DataFrame, columns: Sequence[str], centres: list[list[float]]) -> DataFrame:
    """Add the ``cluster`` of the nearest centre, the first of equals; NULL where a column is NULL or NaN."""
    choices = []
    for i, centre in enumerate(centres):
        squares = " + ".join(f"(`{c}` - {float(x)!r}D) * (`{c}` - {float(x)!r}D)" for c, x in zip(columns, centre, strict=True))
        choices.append(f"named_struct('distance', {squares}, 'cluster', {i})")
    known = " AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns)
    return df.withColumn("cluster", F.expr(f"CASE WHEN {known} THEN array_min(array({', '.join(choices)})).cluster END"))


@dataclass
class Fit:
    rows: DataFrame  # the input with its cluster; NULL where a column is missing
    centres: list[list[float]]  # in deviations if the columns were scaled
    rounds: int


def lloyd(
    df: DataFrame,
    columns: Sequence[str] = fixed.DRIVER_FEATURES,
    k: int = fixed.CLUSTERS,
    max_rounds: int = 100,
    scale: bool = True,
) -> Fit:
    """Clusters of the rows of ``df``.

    Equal rows are fitted as one row with a weight. A round is one pass over this stored table, whose
    sums are combined before they are shuffled; only the ``k`` centres come to the driver. A centre
    without rows stays where it is.
    """
    require_columns(df, columns)
    kept = store(df, "lloyd-input")
    inputs = [f"{c}_std" for c in columns]
    scaled = standardise(kept, columns)
    if not scale:
        scaled = kept.withColumns({f"{c}_std": F.col(c).cast("double") for c in columns})
    weighted = store(scaled.groupBy(*inputs).agg(F.count("*").cast("double").alias("weight")), "lloyd-rows")
    centres = starting_centres(k, len(columns))
    if not scale:
        moments = weighted.agg(*(F.sum(F.col(c) * F.col("weight")) / F.sum("weight") for c in inputs)).first()
        spread = kept.agg(*(F.stddev_pop(c) for c in columns)).first()
        centres = [[(m or 0.0) + x * (s or 0.0) for x, m, s in zip(row, moments, spread, strict=True)] for row in centres]
    rounds = 0
    for rounds in range(1, max_rounds + 1):  # noqa: B007
        placed = place(weighted, inputs, centres).where("cluster IS NOT NULL")
        means = [(F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c) for c in inputs]
        moved = {r["cluster"]: [r[c] for c in inputs] for r in placed.groupBy("cluster").agg(*means).collect()}
        before, centres = centres, [moved.get(i, old) for i, old in enumerate(centres)]
        if all(abs(a - b) <= REST for old, new in zip(before, centres, strict=True) for a, b in zip(old, new, strict=True)):
            break
    found = place(scaled, inputs, centres)
    return Fit(found.select(*df.columns, "cluster"), centres, rounds)


def cluster_report(
    df: DataFrame, columns: Sequence[str] = fixed.DRIVER_FEATURES, k: int = fixed.CLUSTERS, scale: bool = True
) -> DataFrame:
    """Per cluster: rows, mean of each column and the sum of squared distances of its rows from that mean."""
    rows = lloyd(df, columns, k, scale=scale).rows
    grouped = rows.where("cluster IS NOT NULL").groupBy("cluster")
    spread = sum((F.var_pop(c) for c in columns), F.lit(0.0)) * F.count("*")
    return grouped.agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns), spread.alias("squares")
    )
