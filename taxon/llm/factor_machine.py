"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], so that all pairs of
features interact through factors of low rank at a cost linear in the features present.

Words of the whole text are hashed to buckets and weigh by the root of their count, scaled to unit
length; statistics are standardised on the training rows. The machine is fitted with Adam on a bounded
sample of the labelled rows, the ones with the smallest hash of their id; ``max_rows`` is the bound.

Defined results: a null or empty text has no words, and its statistics are zero; it gets a score like
any other. Without training rows of both labels every score is the share of label 1, or 0.5 without
any row. Rows with a null label do not train; an id with several labels counts with the smallest.
Metadata that is null is zero. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxon.llm.common import chunks, code_points, run_hashes, runs

STRUCTURE = 14


@dataclass(frozen=True)
class Settings:
    """Documented parameters."""

    bits: int = 14
    rank: int = 8
    max_rows: int = 8192
    steps: int = 800
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


@dataclass(frozen=True)
class Machine:
    bits: int
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def featurise(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of hashed words (row bounds, buckets, weights) and dense structure statistics."""
    codes, first = code_points(texts)
    n = len(texts)
    low = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    starts, ends = runs(~space)
    word_row = np.searchsorted(first, starts, side="right") - 1
    words = run_hashes(low, ~space, starts, ends)
    key = (word_row.astype(np.int64) << bits) | (words >> np.uint64(64 - bits)).astype(np.int64)
    keys, counts = np.unique(key, return_counts=True)
    rows, buckets = keys >> bits, keys & ((1 << bits) - 1)
    weights = np.sqrt(counts.astype(np.float32))
    norm = np.sqrt(np.bincount(rows, weights=counts, minlength=n))
    weights = (weights / norm[rows]).astype(np.float32)
    bounds = np.searchsorted(rows, np.arange(n + 1))

    # a text's characters are summed as differences of running counts, up to the newline after it
    last = np.append(first[1:] - 1, len(codes) - 1)

    def share(mask: np.ndarray, total: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(mask)))
        return (run[last] - run[first]) / np.maximum(total, 1)

    chars = (last - first).astype(np.float64)
    n_words = np.bincount(word_row, minlength=n).astype(np.float64)
    distinct = np.bincount(rows, minlength=n)
    alone = np.concatenate(([False], (words[1:] == words[:-1]) & (word_row[1:] == word_row[:-1]))) if len(words) else np.zeros(0, bool)
    upper = (codes >= 65) & (codes <= 90)
    letters = ((low >= 97) & (low <= 122)) | (codes >= 0xC0)
    copies = np.zeros(n)
    for k, text in enumerate(texts):
        lines = [x for x in text.split("\n") if x]
        copies[k] = 1 - len(set(lines)) / len(lines) if lines else 0
    dense = np.stack(
        [
            np.log1p(chars),
            np.log1p(n_words),
            share(~space, n_words) / 10,
            share(upper, chars),
            share((codes >= 48) & (codes <= 57), chars),
            share(letters, chars),
            share((codes == 33) | (codes == 63), chars),
            share(np.isin(codes, np.frombuffer("#*$%&|<>".encode("utf-32-le"), np.uint32)), chars),
            share((codes == 44) | (codes == 46), chars),
            share(codes == 10, chars),
            share((codes == 60) | (codes == 62) | (codes == 47), chars),
            distinct / np.maximum(np.minimum(n_words, 1 << bits), 1),
            np.bincount(word_row, weights=alone, minlength=n) / np.maximum(n_words, 1),
            copies,
        ],
        axis=1,
    )
    return bounds, buckets, weights, dense


def _with_dense(bounds: np.ndarray, buckets: np.ndarray, weights: np.ndarray, dense: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that hold their sparse features and then all dense ones."""
    n, wide = dense.shape
    size = np.diff(bounds) + wide
    out = np.concatenate(([0], np.cumsum(size)))
    cols, vals = np.empty(out[-1], dtype=np.int64), np.empty(out[-1], dtype=np.float32)
    at = np.arange(len(buckets)) + np.repeat(np.arange(n) * wide, np.diff(bounds))
    cols[at], vals[at] = buckets, weights
    tail = out[1:, None] - wide + np.arange(wide)
    cols[tail], vals[tail] = first + np.arange(wide), dense
    return out, cols, vals


def _standard(dense: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((dense - mean) / scale, -4, 4) / np.sqrt(dense.shape[1])


def raw_scores(machine: Machine, bounds: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """The machine's value for each row, by the sum-of-squares identity."""
    x = vals[:, None]
    sums = np.add.reduceat(machine.factors[cols] * x, bounds[:-1], axis=0)
    squares = np.add.reduceat(np.square(machine.factors[cols]).sum(axis=1) * np.square(vals), bounds[:-1])
    return machine.bias + np.add.reduceat(machine.linear[cols] * vals, bounds[:-1]) + 0.5 * (np.square(sums).sum(axis=1) - squares)


def fit_machine(bounds: np.ndarray, buckets: np.ndarray, weights: np.ndarray, dense: np.ndarray, y: np.ndarray, settings: Settings) -> Machine:
    """Adam on the logistic loss over mini-batches in a seeded order."""
    mean, scale = (dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-6)) if len(y) else (np.zeros(dense.shape[1]), np.ones(dense.shape[1]))
    width = (1 << settings.bits) + dense.shape[1]
    rng = np.random.default_rng(settings.seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    linear = np.zeros(width, dtype=np.float32)
    factors = rng.normal(0, 0.01, (width, settings.rank)).astype(np.float32)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Machine(settings.bits, bias, linear, np.zeros_like(factors), mean, scale)
    bounds, cols, vals = _with_dense(bounds, buckets, weights, _standard(dense, mean, scale), 1 << settings.bits)
    m1, v1, m2, v2 = np.zeros_like(linear), np.zeros_like(linear), np.zeros_like(factors), np.zeros_like(factors)
    mb = vb = 0.0
    step = 0
    while step < settings.steps:
        order = rng.permutation(len(y))
        for low in range(0, len(y), settings.batch)[: settings.steps - step]:
            rows = np.sort(order[low : low + settings.batch])
            size = bounds[rows + 1] - bounds[rows]
            own = np.concatenate(([0], np.cumsum(size)))
            at = np.arange(own[-1]) + np.repeat(bounds[rows] - own[:-1], size)
            c, x = cols[at], vals[at]
            vx = factors[c] * x[:, None]
            sums = np.add.reduceat(vx, own[:-1], axis=0)
            value = bias + np.add.reduceat(linear[c] * x, own[:-1]) + 0.5 * (np.square(sums).sum(axis=1) - np.add.reduceat(np.square(vx).sum(axis=1), own[:-1]))
            error = ((1 / (1 + np.exp(-np.clip(value, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            each = np.repeat(error, size) * x
            touched, inverse = np.unique(c, return_inverse=True)
            g1 = np.bincount(inverse, weights=each, minlength=len(touched)).astype(np.float32) + settings.decay * linear[touched]
            inner = each[:, None] * (np.repeat(sums, size, axis=0) - vx)
            g2 = np.stack([np.bincount(inverse, weights=inner[:, f], minlength=len(touched)) for f in range(settings.rank)], axis=1).astype(np.float32)
            g2 += settings.decay * factors[touched]
            step += 1
            up, uq = 1 - 0.9**step, 1 - 0.999**step
            m1[touched] = 0.9 * m1[touched] + 0.1 * g1
            v1[touched] = 0.999 * v1[touched] + 0.001 * g1 * g1
            linear[touched] -= settings.rate * (m1[touched] / up) / (np.sqrt(v1[touched] / uq) + 1e-8)
            m2[touched] = 0.9 * m2[touched] + 0.1 * g2
            v2[touched] = 0.999 * v2[touched] + 0.001 * g2 * g2
            factors[touched] -= settings.rate * (m2[touched] / up) / (np.sqrt(v2[touched] / uq) + 1e-8)
            gb = float(error.sum())
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            bias -= settings.rate * (mb / up) / (np.sqrt(vb / uq) + 1e-8)
    return Machine(settings.bits, float(bias), linear, factors, mean, scale)


def _metadata(columns: list[str]) -> Column:
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return F.array(*[F.signum(v) * F.log1p(F.abs(v)) for v in values]) if values else F.array().cast("array<double>")


def _dense(structure: np.ndarray, meta: list) -> np.ndarray:
    more = np.array([list(m) for m in meta], dtype=np.float64).reshape(len(structure), -1)
    return np.concatenate([structure, np.nan_to_num(more)], axis=1)


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    metadata: list[str] | None = None, settings: Settings = Settings(),
) -> Machine:
    """Fit on at most ``settings.max_rows`` labelled rows. Ids alone are ranked; only chosen texts move."""
    y = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.min(label).cast("int").alias("y"))
    mark = F.xxhash64(F.col("id"))
    lowest = y.select(mark.alias("mark")).orderBy("mark").limit(settings.max_rows).agg(F.max("mark")).first()[0]
    chosen = y.filter(mark <= (-(1 << 63) if lowest is None else lowest))
    bits = settings.bits

    def featurised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = 0
            for run in chunks(batch["text"]):
                bounds, buckets, weights, dense = featurise(run, bits)
                part = batch.iloc[done : done + len(run)]
                done += len(run)
                dense = _dense(dense, list(part["meta"]))
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(), "y": part["y"].to_numpy(), "dense": list(dense),
                        "buckets": [buckets[a:b].astype(np.int32) for a, b in zip(bounds, bounds[1:], strict=False)],
                        "weights": [weights[a:b] for a, b in zip(bounds, bounds[1:], strict=False)],
                    }
                )

    own = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), _metadata(metadata or []).alias("meta"))
    own = own.filter(mark <= (-(1 << 63) if lowest is None else lowest))
    rows = own.join(chosen, "id").select(F.col("id").cast("string").alias("id"), "y", "text", "meta")
    got = rows.mapInPandas(featurised, "id string, y int, dense array<double>, buckets array<int>, weights array<float>")
    sample = got.limit(settings.max_rows).toPandas().sort_values(["id", "y"])
    width = STRUCTURE + len(metadata or [])
    bounds = np.concatenate(([0], np.cumsum([len(b) for b in sample["buckets"]]))).astype(np.int64)
    flat = lambda name, kind: np.concatenate([np.zeros(0, kind), *sample[name]]).astype(kind)
    dense = np.array(list(sample["dense"]), dtype=np.float64).reshape(len(sample), width)
    return fit_machine(bounds, flat("buckets", np.int64), flat("weights", np.float32), dense, sample["y"].to_numpy(dtype=np.float64), settings)


def score(machine: Machine, text: Column | str, metadata: list[str] | None = None) -> Column:
    """Probability of label 1 for each whole text."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, meta in batches:
            values, done, meta = [], 0, list(meta)
            for part in chunks(texts):
                bounds, buckets, weights, dense = featurise(part, machine.bits)
                dense = _standard(_dense(dense, meta[done : done + len(part)]), machine.mean, machine.scale)
                done += len(part)
                value = raw_scores(machine, *_with_dense(bounds, buckets, weights, dense, 1 << machine.bits))
                values.append(1 / (1 + np.exp(-np.clip(value.astype(np.float64), -30, 30))))
            yield pd.Series(np.concatenate([np.zeros(0), *values]))

    return F.pandas_udf(run, "double")(F.col(text) if isinstance(text, str) else text, _metadata(metadata or []))
