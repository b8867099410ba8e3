"""Language identification by mixture inference.

A language is a distribution over hashed character trigrams, counted over every training text. A
document is a bag of words, each written in one hidden language; expectation-maximisation estimates
the share of each language from the words' trigram likelihoods. The set of languages is selected by
penalised likelihood: languages join in the order of their shares for as long as the likelihood,
less a penalty for each further share that has to be estimated, rises.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text when
there is no training row with a language and a letter. Repeated rows are scored alike, and count as
often as they occur in training. Columns other than the named ones are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxon.llm.common import CHUNK_CHARS, chunks, code_points, private, runs

UNKNOWN = "und"
#: Least log-likelihood of a word in a language, relative to its best language.
FLOOR = -50.0


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of trigram buckets, one column for each language."""

    languages: tuple[str, ...]
    log_p: np.ndarray


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; built once in each Python worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def _grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket around every letter; start and end of words among them; text of each word."""
    codes, text_starts = code_points([t.lower() for t in texts])
    mask = _letters()[codes]
    starts, ends = runs(mask)
    codes = np.where(mask, codes, np.uint32(0))
    at = np.flatnonzero(mask)
    h = codes[at - 1] * np.uint32(0x9E3779B1) + codes[at] * np.uint32(0x85EBCA77) + codes[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    first = np.concatenate(([0], np.cumsum(ends - starts)))
    return (h >> np.uint32(32 - bits)).astype(np.int64), first[:-1], first[1:], np.searchsorted(text_starts, starts, side="right") - 1


def count_grams(docs: DataFrame, text: str, lang: str, bits: int) -> DataFrame:
    """Trigram counts of each language: ``lang, bucket, n``; one partial count for each task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, group in batch.groupby("lang"):
                own = total.setdefault(name, np.zeros(1 << bits, dtype=np.int64))
                for run in chunks(group["text"]):
                    own += np.bincount(_grams(run, bits)[0], minlength=1 << bits)
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": own[at]})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    counts = rows.mapInPandas(count, "lang string, bucket long, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = 15, max_languages: int = 1000, smoothing: float = 0.5
) -> LanguageModel:
    """Model of every language that the rows name.

    What reaches the driver is at most 2**bits numbers for each language; more than
    ``max_languages`` languages are refused.
    """
    counts = count_grams(docs, text, lang, bits)
    per_language = (
        counts.groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts"))  # at most 2**bits entries
        .select("lang", F.col("counts.bucket").alias("buckets"), F.col("counts.n").alias("n"))
        .limit(max_languages + 1)
        .toPandas()
        .sort_values("lang")
    )
    if len(per_language) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    log_p = np.zeros((1 << bits, len(per_language)), dtype=np.float32)
    for k, (buckets, n) in enumerate(zip(per_language["buckets"], per_language["n"], strict=True)):
        own = np.full(1 << bits, smoothing)
        own[np.asarray(buckets)] += np.asarray(n)
        log_p[:, k] = np.log(own / own.sum())
    return LanguageModel(tuple(per_language["lang"]), log_p)


def _em(like: np.ndarray, of: np.ndarray, first: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document's languages after ``steps`` rounds, and the log-likelihood."""
    for _ in range(steps):
        weight = like * share[of]
        weight /= weight.sum(axis=1, keepdims=True)
        share = np.add.reduceat(weight, first, axis=0) / n[:, None]
        share /= share.sum(axis=1, keepdims=True)
    seen = np.log((like * share[of]).sum(axis=1, dtype=np.float64))
    return share, np.add.reduceat(seen, first)


def infer_mixtures(texts: list[str], model: LanguageModel, steps: int = 12, penalty: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Shares over all languages, and over the selected set, for each text; rows of zeros without a letter."""
    size = len(model.languages)
    full, chosen = np.zeros((len(texts), size)), np.zeros((len(texts), size))
    if not size:
        return full, chosen
    bits = int(model.log_p.shape[0]).bit_length() - 1
    buckets, first_gram, _, text_of = _grams(texts, bits)
    if not len(buckets):
        return full, chosen
    score = np.stack([np.add.reduceat(model.log_p[buckets, k], first_gram) for k in range(size)], axis=1)
    like = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), FLOOR))
    docs, first, of, n = np.unique(text_of, return_index=True, return_inverse=True, return_counts=True)
    share, _ = _em(like, of, first, n, np.full((len(docs), size), 1 / size, dtype=np.float32), steps)
    full[docs] = share
    order = np.argsort(-share, axis=1, kind="stable")
    rows = np.arange(len(docs))
    best = np.zeros_like(share)
    best[rows, order[:, 0]] = 1
    best_value = np.add.reduceat(np.log(like[np.arange(len(of)), order[of, 0]].astype(np.float64)), first)
    open_ = np.ones(len(docs), dtype=bool)
    for k in range(2, size + 1):
        words = open_[of]
        if not words.any():
            break
        sub = np.flatnonzero(open_)
        start = np.zeros((len(sub), size), dtype=np.float32)
        np.put_along_axis(start, order[sub, :k], 1 / k, axis=1)
        sub_of = np.cumsum(open_)[of[words]] - 1
        sub_first = np.concatenate(([0], np.cumsum(n[sub])[:-1]))
        got, value = _em(like[words], sub_of, sub_first, n[sub], start, steps)
        value -= penalty * (k - 1) * np.log(np.maximum(n[sub], 2)) / 2
        better = value > best_value[sub]
        best[sub[better]], best_value[sub[better]] = got[better], value[better]
        open_[sub[~better]] = False
    chosen[docs] = best
    return full, chosen


def language_of(model: LanguageModel, text: Column | str) -> Column:
    """Struct of ``lang_pred``, ``score`` (its share), ``n_languages`` and ``mixture`` of a text column."""
    shared = model

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = shared.languages
        for batch in batches:
            parts = []
            for run in chunks(batch, CHUNK_CHARS):
                full, chosen = infer_mixtures(run, shared)
                for a, b in zip(full, chosen, strict=True):
                    if not b.any():
                        parts.append((UNKNOWN, 0.0, 0, ""))
                        continue
                    at = int(np.argmax(b))
                    kept = [i for i in np.argsort(-b, kind="stable") if b[i] > 0]
                    mixture = ",".join(f"{names[i]}:{b[i]:.4f}" for i in kept)
                    parts.append((names[at], float(min(1.0, a[at])), len(kept), mixture))
            yield pd.DataFrame(parts, columns=["lang_pred", "score", "n_languages", "mixture"])

    # declared nondeterministic, so that filters on its fields are not pushed below it and repeat it
    udf = F.pandas_udf(predict, "lang_pred string, score double, n_languages int, mixture string").asNondeterministic()
    return udf(F.col(text) if isinstance(text, str) else text)


def keep_identified(docs: DataFrame, model: LanguageModel, min_share: float = 0.3) -> DataFrame:
    """Rows whose main language is known and holds ``min_share`` of the words; columns as they came."""
    name = private("language")
    scored = docs.withColumn(name, language_of(model, "text"))
    return scored.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= min_share)).drop(name)
