"""Total order over a whole table: ranks and top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayscore.session import store


def store_ordered(
    df: DataFrame, name: str, *order: Column | str, parts: int | None = None
) -> DataFrame:
    """Write ``df`` in a total order and add where each row stands in it.

    ``row_mark`` is ``monotonically_increasing_id`` of the range-sorted rows: the
    partition number in the upper bits and the row number in it in the lower 33.
    ``part`` is that partition number. Both are written, because the boundaries
    of the partitions are sampled and must not change between later uses.
    """
    if parts:
        ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    else:
        ordered = df.orderBy(*order)
    marked = store(ordered.withColumn("row_mark", F.monotonically_increasing_id()), name)
    return marked.withColumn("part", F.shiftright("row_mark", 33))


def row_in_part() -> Column:
    """The 0-based number of a stored row in its part, from ``row_mark``."""
    return F.col("row_mark").bitwiseAND(F.lit((1 << 33) - 1))


def add_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number all rows 1..N in a total order without gathering them.

    A row's rank is its number in its part plus the rows of the earlier parts,
    which come from a table with one row per part.
    """
    ordered = store_ordered(df, "ranked", *order)
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "part", F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before")
    )
    return (
        ordered.join(F.broadcast(starts), "part")
        .withColumn(name, F.col("rows_before") + row_in_part() + 1)
        .select(*df.columns, name)
    )


def top_n(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The first ``n`` rows, every task keeping only its own first n; all rows for None."""
    ordered = df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)
