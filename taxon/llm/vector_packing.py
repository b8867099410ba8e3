"""Best-fit packing of documents into sequences under several capacities at once.

A bin has a residual vector: tokens, documents and attention cost (the sum of squared lengths). Pieces
come longest first; every open bin that has room in each capacity is scored by the weighted norm of the
residual that the piece would leave, or by the weighted product of demand and residual, and the best
takes the piece. Pieces are dealt at random into groups of a fixed expected size, and each group is
packed in a task of its own, so no task sees more as the corpus grows; a group leaves about one bin
partly filled.

Defined results: a null or empty text is the separator alone. Repeated rows, ids or texts are packed
as often as they occur. An empty table gives an empty result. Columns other than the named ones are
ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxon.llm.common import written


@dataclass(frozen=True)
class Packing:
    """Documented parameters. ``attention`` of None leaves the attention cost unbounded."""

    tokens: int = 2048
    documents: int = 2048
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    rule: str = "norm"  # or "dot"
    group: int = 8192
    separator: int = 0
    tokenizer: str = ""  # file of the tokenizers library; empty: the public byte-level one
    ranks: str = ""  # the same vocabulary as ranks


def _paths(packing: Packing) -> tuple[str, str]:
    if packing.tokenizer:
        return packing.tokenizer, packing.ranks
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of texts. Texts of Latin-1 letters go through the rank table, which gives the same ids four
    times as fast; any other text goes through the tokenizers library itself."""

    def __init__(self, tokenizer: str, ranks: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and _plain(text):
            return np.asarray(self.fast.encode(text, allowed_special="all"), dtype=np.uint32)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _plain(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece: only the first may be shorter than ``size``."""
    head = n % size
    starts = ([0] if head else []) + list(range(head, n, size))
    ends = [*starts[1:], n]
    return [(a, b - a) for a, b in zip(starts, ends, strict=True)]


def pieces(docs: DataFrame, key: str, text: str, packing: Packing, keep_ids: bool) -> DataFrame:
    """One row for each piece, with a random number that was drawn once and is stored with it."""
    tokenizer, ranks = _paths(packing)

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer, ranks)
        draw = np.random.default_rng([17, TaskContext.get().partitionId()])
        end = np.array([packing.separator], dtype=np.uint32)
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.concatenate([encoder.ids(body), end]) if isinstance(body, str) and body else end
                for k, (start, length) in enumerate(cut(len(ids), packing.tokens)):
                    own = np.ascontiguousarray(ids[start : start + length], dtype="<u4")
                    rows.append((doc_id, k, start, length, zlib.crc32(own.tobytes()), own.astype(np.int32) if keep_ids else None))
                if len(rows) > 4096:
                    yield _frame(rows, draw)
                    rows = []
            yield _frame(rows, draw)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInPandas(tokenize, "doc_id string, piece int, start long, length long, ids_crc32 long, ids array<int>, lot long")
    found = found.withColumn("doc_id", F.col("doc_id").cast(kind))
    return found if keep_ids else found.drop("ids")


def _frame(rows: list[tuple], draw: np.random.Generator) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return out.assign(lot=draw.integers(0, 1 << 62, len(rows)))


def best_fit(lengths: np.ndarray, packing: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Bins without room for the shortest piece left are set aside."""
    capacity = np.array([packing.tokens, packing.documents, packing.attention or float("inf")], dtype=np.float64)
    scale = np.where(np.isfinite(capacity), capacity, 1.0)
    weights = np.array(packing.weights)
    demand = np.stack([lengths, np.ones(len(lengths)), np.square(lengths, dtype=np.float64)], axis=1).astype(np.float64)
    if not packing.attention:
        demand[:, 2] = 0
        capacity[2] = 0
    if (demand > capacity).any():
        raise ValueError("a piece is larger than a sequence")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    left, number = np.empty((0, 3)), np.empty(0, dtype=np.int64)
    made = 0
    order = np.argsort(-lengths, kind="stable")
    shortest = demand.min(axis=0) if len(lengths) else capacity
    used: list[int] = []
    for i in order:
        after = left - demand[i]
        fits = np.flatnonzero((after >= 0).all(axis=1))
        if len(fits):
            if packing.rule == "dot":
                at = fits[np.argmax((weights * demand[i] / scale * left[fits] / scale).sum(axis=1))]
            else:
                at = fits[np.argmin((weights * np.square(after[fits] / scale)).sum(axis=1))]
            left[at] = after[at]
        else:
            at = len(left)
            left = np.concatenate([left, [capacity - demand[i]]])
            number = np.append(number, made)
            used.append(0)
            made += 1
        bins[i], offsets[i] = number[at], used[number[at]]
        used[number[at]] += int(lengths[i])
        if (left[at] < shortest).any():
            left, number = np.delete(left, at, axis=0), np.delete(number, at)
    return bins, offsets


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", packing: Packing = Packing(), keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece, and ``ids`` if kept."""
    cut_up = written(pieces(docs, key, text, packing, keep_ids), "pieces")
    groups = max(1, -(-cut_up.count() // packing.group))
    width = 1 << 32

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit(block["length"].to_numpy(), packing)
        return block.assign(sequence_id=block["group_id"] * width + bins, offset=offsets).drop(columns=["group_id", "lot"])

    kind = docs.schema[key].dataType.simpleString()
    columns = f"doc_id string, piece int, start long, length long, ids_crc32 long{', ids array<int>' if keep_ids else ''}, sequence_id long, offset long"
    grouped = cut_up.withColumns({"group_id": F.col("lot") % groups, "doc_id": F.col("doc_id").cast("string")})
    packed = grouped.groupBy("group_id").applyInPandas(fill, columns)
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
