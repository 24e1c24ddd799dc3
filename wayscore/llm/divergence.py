"""How far sources of a language differ in their words, by exact products of indicator matrices.

The terms of a language are the rows of a matrix whose columns are the pairs (source, count level); a
cell says whether the source has the term that many times. The product of the matrix with its
transpose holds the joint table of levels of every pair of sources, and what a cell of a joint table is
worth follows from its two levels. Blocks of terms and of sources are multiplied in separate tasks, and
each prices its own tables, so only one sum per pair and block is moved.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import store
from .common import frugal, prepare_workers, table

LEAST_DOCUMENTS = 10  # of a language that hold a kept term
TOP_TERMS = 10
SCALE = 1_000_000_000
TERM_BLOCK = 1_024  # terms in a block, on average
SOURCE_BLOCK = 256  # sources in a block, on average
COLUMNS = 2_048  # indicator columns in one product, or one term's if they are more
FLUSH = 300_000

# ASCII letters in lower case and all bytes above ASCII stay; anything else parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_COUNTED = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


@frugal
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def emit():
        for (lang, source), (times, docs) in counts.items():
            words = list(times)
            columns = [
                pa.array([lang] * len(words), pa.string()), pa.array([source] * len(words), pa.string()), pa.array(words, pa.string()),
                pa.array(times.values(), pa.int64()), pa.array(map(docs.__getitem__, words), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            times, docs = counts[lang, source]
            found = Counter(terms(text))
            size -= len(times)
            times.update(found)
            docs.update(found.keys())
            size += len(times)
            if size >= FLUSH:  # keeps a worker's memory small
                yield from emit()
                size = 0
    yield from emit()


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, total, first) of the kept terms, stored: n times in the source, total times
    in the language; first marks one row per term."""
    prepare_workers(docs.sparkSession)
    parts = docs.select("lang", "source", "text").mapInArrow(_count, _COUNTED)
    # Dealt out by (lang, term), both the sums per source and those per language need no other exchange.
    counted = parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    summed = counted.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("docs"),
        (F.col("source") == F.min("source").over(term)).alias("first"),
    )
    return store(summed.where(F.col("docs") >= least).drop("docs"), "kept-terms")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, terms, sources) of every group, stored: occurrences of kept terms in
    the group and its language, kept terms and sources of the language."""
    found = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("first").cast("long")).alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(found, ["lang", "source"], "left")
    groups = store(groups.select("lang", "source", zero("size"), zero("terms")), "groups")
    langs = groups.groupBy("lang").agg(
        F.sum("size").alias("lang_size"), F.sum("terms").alias("terms"), F.count("*").alias("sources")
    )
    return store(groups.drop("terms").join(langs, "lang"), "group-sizes")


def price(count: str, size: str) -> Column:
    """The smoothed share of a count, in whole SCALE-ths and one more; decimals, as the product outgrows a long."""
    whole = f"greatest(1, {size} + 2 * terms)"  # 1 only in a language without kept terms
    return F.expr(f"1 + ({SCALE} * CAST({count} + 2 AS DECIMAL(20, 0))) DIV CAST({whole} AS DECIMAL(20, 0))")


def worth(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Below 2^63 for p and q up to SCALE + 1."""
    return (p - q) ** 2 // (p + q)


def one_hot(levels: np.ndarray, first: int, columns: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Indicator matrix of rows ``first`` on: as many rows as give at most ``columns`` columns, or one.

    ``levels[row, source]`` numbers each (source, level); gives the matrix, how many rows it took, and
    the number of each column.
    """
    take = len(levels) - first
    while True:
        used, column = np.unique(levels[first : first + take], return_inverse=True)
        if len(used) <= columns or take == 1:
            break
        take = max(1, take // 2)
    matrix = np.zeros((take, len(used)), np.float32)
    matrix[np.arange(take)[:, None], column.reshape(take, -1)] = 1
    return matrix, take, used


def pair_values(counts: np.ndarray, prices: np.ndarray, columns: int = COLUMNS) -> np.ndarray:
    """Value of every pair of sources over some terms: ``counts`` and ``prices`` are [term, source].

    Cells of the products are whole numbers up to the number of rows, so ``float32`` holds them exactly.
    """
    n, sources = counts.shape
    out = np.zeros((sources, sources), np.int64)
    if not n:
        return out
    # Similar terms together share levels, so one product takes more of them.
    order = np.argsort(counts.sum(1), kind="stable")
    source = np.broadcast_to(np.arange(sources), counts.shape)[order].ravel()
    at = np.lexsort((counts[order].ravel(), source))
    level, owner = counts[order].ravel()[at], source[at]
    new = np.ones(len(at), bool)
    new[1:] = (level[1:] != level[:-1]) | (owner[1:] != owner[:-1])
    numbers = np.empty(len(at), np.int64)
    numbers[at] = np.cumsum(new) - 1
    owner, paid = owner[new], prices[order].ravel()[at][new]
    levels, done = numbers.reshape(n, sources), 0
    while done < n:
        matrix, took, used = one_hot(levels, done, columns)
        joint = matrix.T @ matrix  # every joint table of two sources' levels
        a, b = np.nonzero(joint)
        values = joint[a, b].astype(np.int64) * worth(paid[used[a]], paid[used[b]])
        np.add.at(out, (owner[used[a]], owner[used[b]]), values)
        done += took
    return out


_PAIRS = "lang string, source string, item string, value long"


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of terms and two blocks of sources. Rows without a term carry each source's price of count 0.

    Terms that none of these sources has aren't here. So each task leaves out what its terms would be
    worth at count 0, and the first block of terms adds that for all terms of the language.
    """
    zero = frame[frame["term"].isna()]
    names, blocks = zero["source"].to_numpy(), zero["block"].to_numpy()
    place = {s: i for i, s in enumerate(names)}
    rows = frame[frame["term"].notna()]
    term, found = pd.factorize(rows["term"])
    counts = np.zeros((len(found), len(names)), np.int64)
    never, everywhere = zero["p"].to_numpy(np.int64), zero["n"].iloc[0]
    prices = np.broadcast_to(never, counts.shape).copy()
    source = rows["source"].map(place).to_numpy(np.int64)
    counts[term, source], prices[term, source] = rows["n"].to_numpy(np.int64), rows["p"].to_numpy(np.int64)
    values = pair_values(counts, prices) + (everywhere - len(found)) * worth(never[:, None], never)
    low, high = frame["low"].iloc[0], frame["high"].iloc[0]
    wanted = ~np.eye(len(names), dtype=bool)
    if low != high:  # pairs within one block have their own task
        wanted &= blocks[:, None] != blocks[None, :]
    a, b = np.nonzero(wanted)
    return pd.DataFrame({"lang": frame["lang"].iloc[0], "source": names[a], "item": names[b], "value": values[a, b]})


def pairs(kept: DataFrame, groups: DataFrame, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, zeros included."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block)).cast("int")
    wide = F.ceil(F.col("sources") / source_block).cast("int")
    shared = groups.select("lang", "source", "size", "terms", blocks.alias("blocks"), wide.alias("wide"))
    own = F.pmod(F.xxhash64("source"), F.col("wide")).cast("int").alias("block")
    cells = kept.join(shared, ["lang", "source"]).select(
        "lang", "source", "term", "n", price("n", "size").alias("p"), own, "wide",
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("part"),
    )
    zeros = shared.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), "terms", price("0", "size").alias("p"),
        own, "wide", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"),
    )
    zeros = zeros.withColumn("n", F.when(F.col("part") == 0, F.col("terms")).otherwise(0)).drop("terms")
    dealt = cells.unionByName(zeros).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    prepare_workers(kept.sparkSession)
    sums = dealt.groupBy("lang", "part", "low", "high").applyInPandas(_block, _PAIRS)
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def raised_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms with a larger share in the source than in the language."""
    shared = groups.select("lang", "source", "size", "lang_size", "terms")
    priced = kept.join(shared, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), price("n", "size").alias("p"), price("total", "lang_size").alias("q")
    )
    return priced.where("p > q").selectExpr("lang", "source", "item", "((p - q) * (p - q)) DIV (p + q) AS value")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and the ``top`` raised terms of each.

    NULL text, lang and source are ''. A row is a document, also a repeated one; a group without terms
    has its pairs, a language without kept terms has pairs of value 0, a single source has none.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    kept = kept_terms(docs, least)
    groups = group_sizes(docs, kept)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(ranked).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pair_rows = pairs(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    term_rows = raised_terms(kept, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
    return pair_rows.select(columns).unionByName(term_rows.where(F.col("rank") <= top).select(columns))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
