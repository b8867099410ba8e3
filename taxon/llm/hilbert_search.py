"""Nearest neighbours by inner product over shifted space-filling curves.

Each curve projects the vectors on a few random orthogonal directions, shifts them, lays them on a grid
by rank and orders them along a Hilbert curve. The order is range-partitioned into blocks; a query is
compared with the blocks of a key window around its own, on every curve. Windows merge, and what they
found is ranked by the exact inner product in double precision.

Recall depends on the window: where vectors have no low-dimensional structure, neighbours are spread
widely over any curve, and the window must span a fair share of the table (see the README for figures).

Defined results: vectors that are null, zero, hold a null or non-finite component, or have another
length than the vectors of most ids take no part. A query is never its own neighbour. Rows that repeat an
id count once, with the least of their vectors (compared component by component), and as a query if one of
them is. Ties go to the smaller id. With fewer candidates than ``k`` all are returned. Columns other than
the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxon.llm.common import mixed, written


@dataclass(frozen=True)
class Curves:
    """Documented parameters. A block holds about ``block`` vectors, there are at most ``max_blocks``."""

    curves: int = 6
    dims: int = 4
    bits: int = 8
    window: float = 0.1  # of all keys, on either side
    block: int = 2048
    max_blocks: int = 65536
    seed: int = 11


TIE_BITS = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells, one row for each point.

    Follows the transpose form: undo the excess rotations from the highest bit down, then Gray-decode, then
    interleave the bits.
    """
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for i in range(len(x)):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & (1 << level)) != 0, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for own in x:
            key = (key << 1) | (((own ^ turn) >> level) & 1)
    return key


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _directions(size: int, setting: Curves) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(setting.seed)
    frames = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, : min(setting.dims, size)] for _ in range(setting.curves)]
    return np.stack(frames), rng.uniform(-0.5, 0.5, (setting.curves, frames[0].shape[1]))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64)


def search(
    table: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", setting: Curves = Curves()
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the nearest rows found for each query."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), is_query.alias("is_query"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(_usable(F.col("v")) & F.col("vec_id").isNotNull()).withColumn("is_query", F.coalesce("is_query", F.lit(False)))
    # repeated rows would take the places of other neighbours
    one = rows.groupBy("vec_id", F.size("v").alias("size")).agg(F.max("is_query").alias("is_query"), F.min("v").alias("v"))
    rows = written(one, "vectors")
    lengths = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    out = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return table.sparkSession.createDataFrame([], out)
    size, total = lengths["size"], lengths["count"]
    rows = rows.filter(F.col("size") == size).drop("size")
    frames, shifts = _directions(size, setting)
    curves, dims = shifts.shape
    flat = np.moveaxis(frames, 0, 1).reshape(size, curves * dims)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                y = _matrix(batch["v"]) @ flat
                yield pd.DataFrame({"axis": range(curves * dims), "s": y.sum(axis=0), "q": np.square(y).sum(axis=0)})

    sums = rows.mapInPandas(moments, "axis int, s double, q double").groupBy("axis").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    sums = sums.toPandas().sort_values("axis")  # one row for each axis of each curve
    mean = (sums["s"] / total).to_numpy()
    spread = np.sqrt(np.maximum((sums["q"] / total).to_numpy() - mean**2, 1e-30))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = (1 << setting.bits) - 1
        for batch in batches:
            if not len(batch):
                continue
            z = ((_matrix(batch["v"]) @ flat - mean) / spread).reshape(len(batch), curves, dims) + shifts
            cells = np.minimum((1 / (1 + np.exp(-1.702 * z)) * (top + 1)).astype(np.int64), top)
            ids = batch["vec_id"].to_numpy()
            for c in range(curves):
                tie = mixed(ids.astype(np.uint64) + np.uint64(c << 40)) >> np.uint64(64 - TIE_BITS)
                place = (hilbert_keys(cells[:, c], setting.bits) << TIE_BITS) | tie.astype(np.int64)
                yield pd.DataFrame({"curve": c, "place": place, "vec_id": ids, "is_query": batch["is_query"].to_numpy(), "v": batch["v"].to_numpy()})

    placed = written(rows.mapInPandas(keyed, "curve int, place long, vec_id long, is_query boolean, v array<double>"), "curve-keys")
    blocks = int(min(setting.max_blocks, max(1, -(-total // setting.block))))
    reach = int(np.ceil(setting.window * blocks)) if blocks > 1 else 0
    bounds = np.zeros((curves, 0), dtype=np.int64)
    if blocks > 1:  # at most max_blocks numbers for each curve
        cuts = [i / blocks for i in range(1, blocks)]
        got = placed.groupBy("curve").agg(F.percentile_approx("place", cuts, max(10000, 20 * blocks)).alias("cuts")).toPandas()
        bounds = np.stack(list(got.sort_values("curve")["cuts"]))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own = np.empty(len(batch), dtype=np.int64)
            curve = batch["curve"].to_numpy()
            for c in np.unique(curve):
                own[curve == c] = np.searchsorted(bounds[c], batch["place"].to_numpy()[curve == c], side="right")
            batch = batch.assign(block=own).drop(columns=["place"])
            yield batch.assign(is_query=False)
            asked = batch[batch["is_query"]]
            for step in range(-reach, reach + 1):
                near = asked.assign(block=asked["block"] + step)
                yield near[(near["block"] >= 0) & (near["block"] < blocks)]

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        asked, there = block[block["is_query"]], block[~block["is_query"]]
        found = []
        if len(asked) and len(there):
            x, ids = _matrix(there["v"]), there["vec_id"].to_numpy()
            q, q_ids = _matrix(asked["v"]), asked["vec_id"].to_numpy()
            step = max(1, (1 << 22) // len(x))
            for low in range(0, len(q), step):
                near = q[low : low + step] @ x.T
                for r, row in enumerate(near):
                    row[ids == q_ids[low + r]] = -np.inf
                    least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                    at = np.flatnonzero((row >= least - 1e-9 * max(1.0, abs(least))) & (row > -np.inf))
                    exact = (x[at] * q[low + r]).sum(axis=1)
                    at = at[best := np.lexsort((ids[at], -exact))[:k]]
                    found.append((int(block["curve"].iloc[0]), int(block["block"].iloc[0]), q_ids[low + r], (-exact[best]).tolist(), ids[at].tolist()))
        return pd.DataFrame(found, columns=["curve", "block", "query_id", "far", "ids"])

    dealt = placed.mapInPandas(deal, "curve int, vec_id long, is_query boolean, v array<double>, block long")
    found = dealt.groupBy("curve", "block").applyInPandas(compare, "curve int, block long, query_id long, far array<double>, ids array<long>")
    near = F.arrays_zip("far", "ids")
    best = lambda lists: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))), 1, k)
    merged = (
        found.withColumn("near", near)
        .groupBy("query_id", "curve", F.floor(F.col("block") / 64).alias("part"))
        .agg(best("near").alias("near"))
        .groupBy("query_id")
        .agg(best("near").alias("near"))
    )
    listed = merged.select("query_id", F.posexplode("near").alias("at", "n"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.ids").alias("vec_id"), (-F.col("n.far")).alias("score"))
