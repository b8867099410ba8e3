"""Centroid clustering (Lloyd's rounds on integer vectors) with a vector-approximation file.

Every vector is stored twice in one row: in full, and as its approximation, a cell of a few bits per
dimension on a uniform grid over that dimension's observed range. For each centroid, a lookup table gives
the smallest and largest squared distance from the centroid to every cell of every dimension, so a sum of
64 table entries brackets a vector's distance to a centroid. A centroid whose lower bound exceeds the
smallest upper bound cannot be nearest; the full vector is used only for the centroids whose intervals
overlap that bound, and exact integer distances decide among them. Ties go to the smaller centroid number.

Scale: each round is one pass over the written vectors in Arrow batches. Each batch sends one row of
partial sums per centroid (count and 64 sums), so the shuffle is a few rows per task whatever the
cluster sizes are; a cluster that holds a third of all vectors is summed map-side like any other. Only
the ``k`` centroids (``k`` x ``dims`` integers) travel through the driver, and the grid (``dims`` ranges).

Defined results: rows with a null vector, another number of components than ``dims``, or a null or
non-finite component take no part and are not returned. Components become floor(64 x) with x as double;
distances are 64-bit integers (exact while components stay within about +-2**28). Rows that repeat a
``vec_id`` are separate vectors; a null ``vec_id`` is a vector like any other, its seed hash is null and
sorts last. Seeds are ordered by hash, then by their integer components. An empty cluster keeps its
centroid. With fewer vectors than ``k``, the missing centroids are never formed and no vector is given
them. An empty table returns no rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxon.llm.common import written


@dataclass(frozen=True)
class Clustering:
    """Documented parameters: the contract's k, rounds, dimension and scale, and the bits of a cell."""

    k: int = 16
    rounds: int = 3
    dims: int = 64
    scale: int = 64
    bits: int = 4
    seed_prefix: str = "1:"


def usable(vector: Column, dims: int) -> Column:
    """True for a vector of ``dims`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == dims) & finite, F.lit(False))


def _matrix(column: pd.Series, dims: int, dtype=np.int64) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dims), dtype=dtype)
    return np.stack(column.to_numpy()).astype(dtype, copy=False)


class Grid:
    """Uniform cells over each dimension's range, and the distance bounds of centroids to cells."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        self.low = low.astype(np.int64)
        self.width = np.maximum(1, -(-(high.astype(np.int64) - self.low + 1) // (1 << bits)))
        self.cells = 1 << bits

    def codes(self, q: np.ndarray) -> np.ndarray:
        return np.clip((q - self.low) // self.width, 0, self.cells - 1).astype(np.int64)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance from each centroid component to each cell: (k, dims, cells)."""
        start = self.low[None, :, None] + self.width[None, :, None] * np.arange(self.cells)[None, None, :]
        end = start + self.width[None, :, None] - 1
        c = centroids[:, :, None]
        below, above = start - c, c - end
        least = np.where(below > 0, below, np.where(above > 0, above, 0)) ** 2
        most = np.maximum((start - c) ** 2, (end - c) ** 2)
        return least, most


def assign(q: np.ndarray, codes: np.ndarray, centroids: np.ndarray, least: np.ndarray, most: np.ndarray):
    """Nearest centroid and squared distance of every row; exact distances only where bounds overlap.

    Returns clusters, distances and the number of (vector, centroid) pairs computed exactly.
    """
    n, dims = q.shape
    k = len(centroids)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    dim_index = np.arange(dims)[None, :]
    lower = np.stack([least[j][dim_index, codes].sum(axis=1) for j in range(k)], axis=1)
    upper = np.stack([most[j][dim_index, codes].sum(axis=1) for j in range(k)], axis=1)
    rows, cols = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
    exact = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
    diff = q[rows] - centroids[cols]
    exact[rows, cols] = np.einsum("ij,ij->i", diff, diff)
    cluster = exact.argmin(axis=1)  # first minimum: the smaller centroid number
    return cluster, exact[np.arange(n), cluster], len(rows)


def cluster(vectors: DataFrame, setting: Clustering = Clustering(), vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable vector."""
    spark = vectors.sparkSession
    dims, k = setting.dims, setting.k
    ints = F.transform(F.col(vector), lambda x: F.floor(F.lit(setting.scale) * x.cast("double")).cast("long"))
    seed = F.sha2(F.concat(F.lit(setting.seed_prefix), F.col(vec_id).cast("string")), 256)
    kept = vectors.filter(usable(F.col(vector), dims)).select(F.col(vec_id).alias("vec_id"), ints.alias("q"), seed.alias("seed"))
    kept = written(kept, "va-vectors")
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"

    ranges = kept.select(F.posexplode("q").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    if not ranges:
        return spark.createDataFrame([], empty)
    low, high = np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
    for r in ranges:
        low[r["dim"]], high[r["dim"]] = r["lo"], r["hi"]
    grid = Grid(low, high, setting.bits)

    seeds = kept.orderBy(F.col("seed").asc_nulls_last(), "q").limit(k).select("q").collect()
    centroids = np.array([r["q"] for r in seeds], dtype=np.int64).reshape(len(seeds), dims)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = _matrix(batch["q"], dims)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "q": list(q), "cells": list(grid.codes(q).astype(np.int8))})

    stored = written(kept.mapInPandas(coded, "vec_id long, q array<long>, cells array<tinyint>"), "va-file")

    for _ in range(setting.rounds):
        least, most = grid.tables(centroids)
        current = centroids

        def partial_sums(batches: Iterator[pd.DataFrame], current=current, least=least, most=most) -> Iterator[pd.DataFrame]:
            for batch in batches:
                q = _matrix(batch["q"], dims)
                chosen, _, _ = assign(q, _matrix(batch["cells"], dims), current, least, most)
                for j in np.unique(chosen):
                    members = q[chosen == j]
                    yield pd.DataFrame({"cluster": [int(j)], "n": [len(members)], "sums": [members.sum(axis=0)]})

        sums = stored.mapInPandas(partial_sums, "cluster int, n long, sums array<long>")
        totals = sums.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(
            F.sum("s").alias("s"), F.sum("n").alias("n")
        )
        updated = centroids.copy()
        for r in totals.collect():
            updated[r["cluster"], r["dim"]] = r["s"] // r["n"]  # exact floor of Python integers
        centroids = updated

    least, most = grid.tables(centroids)
    final = centroids

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chosen, distance, _ = assign(_matrix(batch["q"], dims), _matrix(batch["cells"], dims), final, least, most)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": chosen.astype(np.int32), "distance": distance})

    assigned = written(stored.mapInPandas(placed, "vec_id long, cluster int, distance long"), "va-assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    digest = {j: hashlib.sha256(",".join(str(int(x)) for x in final[j]).encode()).hexdigest() for j in range(len(final))}
    summary = spark.createDataFrame(
        [(j, inertia.get(j, 0), digest[j]) for j in range(len(final))], "cluster int, cluster_inertia long, centroid_sha256 string"
    )
    out = assigned.join(F.broadcast(summary), "cluster")  # k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")

