"""Subword lattice scores against enumeration of segmentations; the base unigram against a plain count."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from taxon.llm import lattice_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small_units():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "c"]
    units = pieces + [f"<0x{b:02X}>" for b in range(256)] + [lattice_lm.END]
    return {u: -math.log(len(units)) - 0.1 * len(u) for u in units}, 3


@pytest.mark.parametrize("word", ["a", "ab", "abab", "ba c", "xé", "b" * 7])
def test_forward_is_the_sum_over_all_segmentations(word):
    logp, longest = small_units()
    paths = lattice_lm.lattice_search_space(word, logp, longest)
    brute = math.log(sum(math.exp(sum(logp[u] for u in path)) for path in paths))
    assert lattice_lm.Lattice(logp, longest).log_probability(word) == pytest.approx(brute, rel=1e-12)


def test_expected_counts_match_enumeration():
    logp, longest = small_units()
    word = "abab"
    paths = lattice_lm.lattice_search_space(word, logp, longest)
    weights = [math.exp(sum(logp[u] for u in p)) for p in paths]
    want = defaultdict(float)
    for p, w in zip(paths, weights):
        for u in p:
            want[u] += 3 * w / sum(weights)
    got = defaultdict(float)
    lattice_lm.Lattice(logp, longest).expect(word, 3.0, got)
    assert set(got) == set(want) and all(got[u] == pytest.approx(want[u]) for u in want)


def test_scores_and_base_on_odd_rows(spark):
    texts = [None, "", "The cat  sat\non the mat", "the CAT", "the cat", "the cat", "ünï cödé " * 500, "x" * 5000, "zzz"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the dog"), (5, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'a' AS words", "'b' AS row", "1 AS score", "'c' AS word", "2 AS c", "3 AS salt"
    )
    setting = lattice_lm.Model(rounds=2, hot_share=0.05, salts=3)
    train_rows = docs.filter(~lattice_lm.held_out(docs["doc_id"]))
    model = lattice_lm.train(train_rows, setting)
    got = {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
           for r in lattice_lm.score(docs, model, setting).collect()}

    def held(d):
        return d is not None and zlib.crc32(str(d).encode()) % 7 == 2

    def words(t):
        return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))

    learned = [t for d, t in rows if not held(d)]
    counts = Counter(w for t in learned for w in words(t))
    n = sum(counts.values()) + len(learned)
    v = len(counts) + 1
    lattice = lattice_lm.Lattice(model["logp"], model["longest"])
    want = set()
    for d, t in rows:
        ws = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(learned) + 1) / (n + v + 1))
        score = (sum(lattice.log_probability(w) for w in ws) + model["logp"][lattice_lm.END]) / math.log(10)
        want.add((d, held(d), len(ws) + 1, sum(1 for w in ws if counts[w]) + 1, n, round(base, 6), round(score, 6)))
    assert got == want


def test_trained_probabilities_follow_the_corpus(spark):
    few = spark.createDataFrame([(1, "aaaa " * 50)], "doc_id long, text string")
    model = lattice_lm.train(few, lattice_lm.Model(rounds=2))
    lattice = lattice_lm.Lattice(model["logp"], model["longest"])
    assert lattice.log_probability("aaaa") > lattice.log_probability("zqxj")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = lattice_lm.train(empty, lattice_lm.Model(rounds=1))
    assert lattice_lm.score(empty, model).count() == 0


def test_many_words_at_once_equal_one_by_one():
    """Words of many lengths, unknown characters, names of units, too long and too improbable for dense arrays."""
    logp, longest = small_units()
    words = ["a", "ab", "abab", "xé", "b" * 7, "</s>", "<0x41>", "日本語" * 9, "ab" * 40, "q" * 200, "\U0001f600a", "ab"]
    many, one = lattice_lm.Lattices(logp, longest), lattice_lm.Lattice(logp, longest)
    assert list(many.log_probability(words)) == pytest.approx([one.log_probability(w) for w in words], rel=1e-12)
    want = defaultdict(float)
    for k, w in enumerate(words):
        one.expect(w, float(k + 1), want)
    got = many.expect(words, lattice_lm.np.arange(1.0, len(words) + 1))
    assert {u: v for u, v in got.items() if v > 1e-12} == pytest.approx({u: v for u, v in want.items() if v > 1e-12}, rel=1e-9)
    assert many.expect([], lattice_lm.np.zeros(0)) == {}


def test_counts_of_many_words_take_no_python_step_for_each_edge():
    """Some 20,000 words are weighed within seconds; edge by edge they took several times as long."""
    import random
    import time

    rng = random.Random(3)
    logp, longest = small_units()
    words = ["".join(rng.choices("abcxyz", k=rng.randrange(6, 14))) for _ in range(20_000)]
    many, one = lattice_lm.Lattices(logp, longest), lattice_lm.Lattice(logp, longest)
    began = time.process_time()
    many.expect(words, lattice_lm.np.ones(len(words)))
    middle = time.process_time()
    for w in words:
        one.expect(w, 1.0, defaultdict(float))
    assert middle - began < (time.process_time() - middle) / 2


def test_words_travel_once_for_each_block_of_documents(spark):
    """300 documents of 200 common words each: no table of a row per (document, word) is written on the way."""
    from pathlib import Path

    from taxon.session import scratch_root

    common = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(i, f"{common} own{i}") for i in range(300)], "doc_id long, text string").coalesce(2)
    model = lattice_lm.train(docs, lattice_lm.Model(rounds=1))
    root = Path(scratch_root(spark).removeprefix("file:"))
    there = set(root.glob("lattice-*"))
    assert lattice_lm.score(docs, model).count() == 300
    made = set(root.glob("lattice-*")) - there
    assert made and sum(spark.read.parquet(str(p)).count() for p in made) < 3_000


def test_scores_do_not_depend_on_the_size_of_blocks(spark):
    texts = [None, "", "a b c", "a a b", "x y z a", "zzz " * 40, "a b c", "ü é", "  ", "b"] * 3
    docs = spark.createDataFrame([(f"k{i}" if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(1)
    model = lattice_lm.train(docs.filter(~lattice_lm.held_out(docs["doc_id"])), lattice_lm.Model(rounds=1))

    def scored(setting):
        return sorted((str(r.doc_id), *r[1:5], round(r.base_score, 9), round(r.score, 9)) for r in lattice_lm.score(docs, model, setting).collect())

    whole = scored(lattice_lm.Model())
    assert len(whole) == len(texts)
    assert scored(lattice_lm.Model(block_words=1, hot_share=0.1, salts=2)) == whole
    assert scored(lattice_lm.Model(block_pairs=5)) == whole
