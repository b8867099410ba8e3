"""Helpers that several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxon.session import scratch_path

CHUNK_CHARS = 1_000_000
ROWS_PER_FILE = 250_000
#: White space that separates words: space and the code points 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: a lost executor re-reads files.

    ``rows``, a known bound of the number of narrow rows, keeps small tables from many tiny files.
    """
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def private(name: str) -> str:
    """Column name that no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text leaves remainder 2 on division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 4 == 2, F.lit(False))


def chunks(texts: Iterable[str | None], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of whole texts of at most ``limit`` characters together; a longer text stands alone."""
    run: list[str] = []
    size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with one newline before each and one at the end; start of each text."""
    joined = "\n" + "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
    return codes, starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values; the first and last value are false."""
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return edges[0::2], edges[1::2]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, dtype=np.uint64)


def terms_in(text: bytes | None, table: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order; ``table`` maps separators to spaces and lower-cases A-Z."""
    return text.translate(table).split() if text is not None else []


def term_table(separators: Iterable[int]) -> bytes:
    """Byte table of ``terms_in``: these ASCII code points separate terms, A-Z become a-z."""
    gaps = set(separators)
    return bytes(0x20 if b in gaps else b + 32 if 65 <= b <= 90 else b for b in range(256))


def powers(n: int) -> np.ndarray:
    """First ``n`` powers of an odd 64-bit base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 64), np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS[:n]


def run_hashes(codes: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the code points of every run of ``mask``."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    values = mixed(codes[mask].astype(np.uint64) + np.uint64(1))
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(values)) - np.repeat(first, lengths)
    values *= powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))
