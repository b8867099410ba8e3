"""Ranked lexical search against a brute-force scorer: nulls, empty texts, ties, repeats, null ids, clashing columns."""

import math
import random
import re
from collections import Counter

from taxon.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=50):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scored = []
        for row, (doc, bag) in enumerate(bags):
            n = sum(bag.values())
            if not n:
                continue
            m = 50 + (50 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                for t in words if t in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0, row, doc))
        scored.sort()
        out += [(item, r + 1, s[4], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


def run(spark, docs, items, setting=lexical_search.Search()):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS row", "'y' AS query", "1 AS impact")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "'z' AS term", "'w' AS rank")
    got = lexical_search.search(d, q, setting).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=lambda r: (str(r[0]), r[1]))


def test_small_cases(spark):
    docs = [
        (1, "The cat sat on the MAT"), (2, None), (3, ""), (4, "!!! 123 ..."), (5, "the cat sat on the mat"),
        (5, "the cat sat on the mat"), (None, "a cat"), (6, "Ünïcode wörds and CAT " * 300), (7, "dog dog dog dog"),
    ]
    items = [(1, "cat mat"), (2, None), (None, "dog cat"), (3, "zebra"), (1, "DOG")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "cat")]) == []
    assert run(spark, [(1, "cat")], []) == []


def test_random_against_brute_force_with_small_k(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "and", "of"]
    weights = [1 / (i + 1) for i in range(40)] + [30, 20, 10]
    docs = [(rng.randrange(60), " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 40)))) for _ in range(150)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 12)))) for i in range(25)]
    setting = lexical_search.Search(k=5, salts=3)
    assert run(spark, docs, items, setting) == brute(docs, items, k=5)


def test_groups_of_queries_and_slices_of_documents(spark, monkeypatch):
    """More query terms than one broadcast may hold, and one slice per document, give the same rows."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30)))) for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=6))) for i in range(12)]
    assert run(spark, docs, items, lexical_search.Search(k=4, salts=2, broadcast_terms=20)) == brute(docs, items, k=4)


def test_pairs_of_query_and_document_are_not_shuffled(spark):
    """Only the k best of a query and slice leave a task; every pair that a term reached was shuffled before."""
    import pyarrow as pa

    plan = lexical_search.pd.DataFrame({"query": ["a", "b"], "term": ["x", "x"], "place": [1, 1], "w": [5, 5]})
    n = 1_000
    batch = pa.record_batch({"row": list(range(n)), "doc_id": list(range(n)), "n": [1] * n, "terms": [["x"]] * n, "tfs": [[1]] * n})
    some = lexical_search._Plan(plan, lexical_search.np.ones(2, dtype=bool))
    out = pa.Table.from_batches(lexical_search._summed(iter([batch]), some, n, n, 3)).to_pylist()
    assert [(r["query"], r["doc_id"]) for r in out] == [(q, d) for q in "ab" for d in range(3)]
