"""Training-text augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxon.operators.splits import seeded_hash

SENTENCE_BREAK = ". "


def seeded_coin(key: str, seed: int) -> Column:
    """True for about half of the keys, always the same half for one seed."""
    return F.substring(seeded_hash(key, seed), 1, 1) >= "8"


def shuffled_sentences(text: Column, key: str, seed: int) -> Column:
    """Sentences in a random order that depends on key and seed only."""
    sentences = F.split(text, r"\. ")
    ordered = F.array_sort(
        F.transform(
            sentences,
            lambda s, i: F.struct(
                F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}|"), i.cast("string")).cast("binary")).alias("h"),
                s.alias("s"),
            ),
        )
    )
    return F.array_join(F.transform(ordered, lambda x: x["s"]), SENTENCE_BREAK)


def augment_texts(df: DataFrame, key: str, text: str = "text", seed: int = 42) -> DataFrame:
    """One or two rows per input row: the text itself and, for half of those with more than
    two sentences, a copy with its sentences shuffled. All other columns are repeated."""
    eligible = seeded_coin(key, seed) & (F.size(F.split(F.col(text), r"\. ")) > 2)
    copy = F.when(eligible, shuffled_sentences(F.col(text), key, seed))
    versions = F.array_compact(F.array(F.col(text), copy))
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(versions).alias("version", text))
