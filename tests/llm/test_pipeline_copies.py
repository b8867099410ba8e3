"""The near_dedup stage against all pairs at a similarity of 0.8."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_first(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return sorted(set(part))


def test_copies_of_80_percent_are_dropped(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(60)]
        texts.append(" ".join(base))
        base[rng.choice([10, 20, 30])] = word()  # 51 of 61 shingles, 0.836
        texts.append(" ".join(base))
        base[rng.choice([0, 1, 2, 3, 40])] = word()
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == brute_first(texts)
