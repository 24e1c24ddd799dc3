"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors are folded into one first. Each distinct vector gets the signs of its products with k
random hyperplanes in each of several tables. Vectors with equal signs in a table are compared exactly;
a bucket larger than ``BLOCK`` is split into blocks, and each pair of blocks is one task. A pair counts
in the first table in which it meets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, store
from .common import table
from .components import connected_components

BLOCK = 1500


def plan(vectors: int, threshold: float, miss: float = 1e-4, bucket: int = 128) -> tuple[int, int]:
    """Signs per table and number of tables.

    Signs grow with the logarithm of the number of vectors, so that buckets of unrelated vectors stay
    near ``bucket``; the tables follow from the wanted chance to miss a pair right at the threshold.
    """
    signs = max(6, math.ceil(math.log2(max(1, vectors) / bucket)))
    same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** signs
    return signs, math.ceil(math.log(miss) / math.log1p(-min(same, 1 - 1e-9)))


def _hash(signs: int, tables: int):
    def hash_vectors(batches):
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(signs)
        for batch in batches:
            codes = []
            for vector in batch["vector"]:
                v = np.asarray(vector, np.float64)
                if v.size not in planes:
                    planes[v.size] = np.random.default_rng(v.size).normal(size=(tables * signs, v.size))
                codes.append(((planes[v.size] @ v).reshape(tables, signs) > 0) @ powers)
            yield batch.assign(codes=[c.astype("int32") for c in codes])

    return hash_vectors


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _compare(threshold: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        t, low, high = int(key[1]), int(key[3]), int(key[4])
        rows = rows.sort_values("rep", kind="stable")
        x = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = np.stack(rows["codes"].to_numpy())[:, :t]
        rep, copies, block = (rows[c].to_numpy() for c in ("rep", "copies", "block"))
        linked = np.triu(x @ x.T >= threshold, 1)
        if low != high:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(linked)
        if not len(a):
            return empty
        links = np.zeros(len(rows), np.int64)
        new = np.ones(len(a), bool)
        for first in range(0, len(a) if t else 0, 100_000):
            part = slice(first, first + 100_000)
            new[part] = ~(codes[a[part]] == codes[b[part]]).any(1)
        np.add.at(links, a[new], copies[b[new]])
        np.add.at(links, b[new], copies[a[new]])
        root = _components(a, b, len(rows))
        touched = np.unique(np.concatenate([a, b]))
        return pd.DataFrame({"rep": rep[touched], "links": links[touched], "root": rep[root[touched]]})

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding).

    Repeated rows are vectors of their own. A vector that is NULL, empty, zero or holds NULL or
    non-finite components links with nothing, and vectors link only with vectors of their length.
    """
    ship_package(vectors.sparkSession)
    value = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", value.alias("vector"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    single = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = rows.where(usable)
    distinct = store(good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct-vectors")
    # One id may be the smallest of several vectors when ids repeat; such rows share their links.
    signs, tables = plan(distinct.count(), threshold)
    hashed = store(
        distinct.mapInPandas(_hash(signs, tables), "vector array<double>, rep long, copies long, codes array<int>"),
        "hashed-vectors",
    )
    keyed = hashed.select(F.size("vector").alias("size"), "rep", F.posexplode("codes").alias("t", "code"))
    buckets = store(
        keyed.groupBy("size", "t", "code").agg(F.count("*").alias("n")).where("n > 1").select(
            "size", "t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
        ),
        "buckets",
    )
    member = hashed.select("rep", "copies", "vector", "codes", F.size("vector").alias("size"), F.posexplode("codes").alias("t", "code"))
    member = member.join(buckets, ["size", "t", "code"])
    member = member.withColumn("block", F.pmod(F.xxhash64("rep", "vector"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = member.select("*", other.alias("other")).select(
        "size", "t", "code", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "rep", "copies", "vector", "codes", "block",
    )
    found = store(
        paired.groupBy("size", "t", "code", "low", "high").applyInPandas(_compare(threshold), "rep long, links long, root long"),
        "vector-links",
    )
    links = store(found.groupBy("rep").agg(F.sum("links").alias("links")), "link-counts")
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = (
        good.join(distinct, "vector")
        .join(links, "rep", "left")
        .join(components, F.col("rep") == components["node"], "left")
        .select(
            "vec_id",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return joined.union(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
