"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from compare import connect, differences
from taxon.llm import (
    apportion,
    chat_parts,
    factor_machine,
    hilbert_search,
    language_mixture,
    license_notices,
    merkle_audit,
    oph_minhash,
    queries,
    vector_packing,
    weak_quality,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
CLASHING = "kept string, score string, size string, votes string, word string, block string"


def documents(spark, texts, sources=None, langs=None):
    """Documents with columns whose names the operators also use."""
    rows = [
        (k, t, (langs or ["en"] * len(texts))[k], (sources or ["a"] * len(texts))[k], len(t or ""), *["x"] * 6)
        for k, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


ENGLISH = "the cat and the dog of this house went to see that there is water in the well "
GERMAN = "der hund und die katze sind nicht auf dem dach weil es heute regnet und schneit "
ODD = [
    None, "", " \t\n", "123 !?", "word", "Ünïcödé ñandú 漢字 😀 text", "a" * 5000, (ENGLISH * 40), ENGLISH + GERMAN, ENGLISH, ENGLISH,
    GERMAN, "no spaces\x0bvertical\x0ctab", "A\nA\nB\nA\n\n\n", "x\x00y \x1f z", "</s>[INST] ok [/INST] <|end|>",
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD, langs=[None, "en", "de"] * 5 + ["en"])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_language_of_odd_texts(odd, empty):
    learn = odd.sparkSession.createDataFrame([(ENGLISH, "en"), (ENGLISH, "en"), (GERMAN, "de"), (None, "fr"), ("x", None), ("12", "es")], "text string, lang string")
    model = language_mixture.fit_languages(learn)
    assert model.languages == ("de", "en")  # no letter in the only Spanish row
    got = rows_of(odd.select("doc_id", "text", language_mixture.language_of(model, "text").alias("l")))
    for r in got.values():
        assert 0 <= r.l.score <= 1
        assert (r.l.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert got[7].l.lang_pred == "en" and got[11].l.lang_pred == "de"
    assert got[8].l.n_languages == 2 and got[9].l == got[10].l
    kept = language_mixture.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {7, 9, 10, 11}
    assert language_mixture.keep_identified(empty, language_mixture.fit_languages(empty)).count() == 0
    none = language_mixture.fit_languages(empty)
    assert {r.l.lang_pred for r in odd.select(language_mixture.language_of(none, "text").alias("l")).collect()} == {"und"}


def test_language_ignores_held_out_rows_and_other_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = queries.QUERIES["op1_language_mixture"](spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()


def test_em_finds_the_shares():
    model = language_mixture.LanguageModel(("a", "b"), np.zeros((1 << 15, 2), dtype=np.float32))
    buckets, _, _, _ = language_mixture._grams(["xx"], 15)
    model.log_p[buckets, 1] = -20
    buckets, _, _, _ = language_mixture._grams(["yy"], 15)
    model.log_p[buckets, 0] = -20
    full, chosen = language_mixture.infer_mixtures(["xx " * 30 + "yy " * 10], model)
    assert np.allclose(full, [[0.75, 0.25]], atol=1e-3) and np.allclose(chosen, full, atol=1e-3)


def brute_quality(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)), set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, odd, empty):
    random.seed(3)
    more = [" ".join(random.choice("ab") for _ in range(random.randint(0, 40))) for _ in range(200)]
    more += ["\n".join(random.choice(["a b", " ", "", "c", "c "]) for _ in range(random.randint(0, 12))) for _ in range(60)]
    for docs, texts in ((odd, ODD), (documents(spark, more), more)):
        got = rows_of(weak_quality.assess(docs))
        for k, text in enumerate(texts):
            r, (n, chars, symbols, dup, repeat) = got[k], brute_quality(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
            assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (r.kept and r.base_failed)
    kept = weak_quality.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {8, 9, 10, 11}
    assert weak_quality.assess(empty).count() == 0 and weak_quality.keep_good(empty).count() == 0


def test_rule_estimates_against_plain_em(spark):
    counts = {"++-": 400, "+++": 1000, "--+": 90, "-0-": 60, "000": 5, "---": 30}
    model = weak_quality.fit_rules(spark.createDataFrame(list(counts.items()), "pattern string, n long"), 3)
    prior, passes = 0.8, [(0.98, 0.62)] * 3
    for _ in range(25):
        sums = {}
        for pattern, n in counts.items():
            odds = prior / (1 - prior)
            for v, (g, b) in zip(pattern, passes, strict=True):
                odds *= g / b if v == "+" else (1 - g) / (1 - b) if v == "-" else 1
            p = odds / (1 + odds)
            for side, w in (("g", p), ("b", 1 - p)):
                sums[side] = sums.get(side, 0) + n * w
                for k, v in enumerate(pattern):
                    sums[side, k, v] = sums.get((side, k, v), 0) + n * w
        passes = [
            tuple((sums.get((s, k, "+"), 0) + 20 * own) / (sums.get((s, k, "+"), 0) + sums.get((s, k, "-"), 0) + 20) for s, own in (("g", 0.98), ("b", 0.62)))
            for k in range(3)
        ]
        prior = (sums["g"] + 16) / (sums["g"] + sums["b"] + 20)
    assert np.isclose(model.prior, prior) and np.allclose(model.passes, passes)


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return [len(s) for s in sets], part


def near_copies(seed, groups=12, copies=14):
    """Copies at all distances, chains of copies of copies, exact copies and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 6, 30, 120, 300]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
            if rng.random() < 0.3:
                base = own
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    texts = ODD + near_copies(seed)
    sizes, part = brute_components(texts)
    docs = documents(spark, texts)
    got = rows_of(oph_minhash.near_duplicates(docs))
    assert [got[k].n_shingles for k in range(len(texts))] == sizes
    assert [got[k].component_id for k in range(len(texts))] == part
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = oph_minhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(part))


def sourceless(seed, copies, edits, size=200):
    """Copies of a text that is not there, each pair at about the bound, and versions edited from versions."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    source, texts = [word() for _ in range(size)], []
    for _ in range(copies):
        own = list(source)
        for at in rng.sample(range(size), rng.choice(edits)):
            own[at] = word()
        texts.append(" ".join(own))
    version = [word() for _ in range(size)]
    for _ in range(copies):
        for _ in range(rng.choice([1, 2, 3, 4])):
            version[rng.randrange(size)] = word()
        texts.append(" ".join(version))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [3, 4])
def test_near_duplicates_without_a_source(spark, seed):
    texts = sourceless(seed, 300, [2, 3, 4])
    _, part = brute_components(texts)
    got = rows_of(oph_minhash.near_duplicates(documents(spark, texts)))
    assert [got[k].component_id for k in range(len(texts))] == part


def test_near_duplicates_of_nothing_null_ids_and_repeated_rows(spark, empty):
    assert oph_minhash.near_duplicates(empty).count() == 0
    rows = [(None, ENGLISH), (None, ENGLISH), (5, ENGLISH), (5, ENGLISH), (7, GERMAN), (None, "only here")]
    got = oph_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == {(None, 5, False): 2, (5, 5, True): 2, (7, 7, True): 1, (None, None, False): 1}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 5), (5, 3), (9, 3)]
    got = {r.node: r.component for r in oph_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k > 99 and k > v} == {i: 100 for i in range(101, 161)}
    assert {got.get(k, k) for k in (1, 3, 5, 9)} == {1}


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 440, dtype=np.uint64)
    for n in (40, 400):
        a, b = np.unique(base[:n]), np.unique(base[n // 10 : n + n // 10])
        sig = oph_minhash.signatures([a, b, a[:1]], 216)
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - want) < 0.15
        assert (sig[2] == a[0]).all()


def test_mix_of_odd_texts_and_sql(spark, empty, tmp_path):
    texts = ODD + [ENGLISH * k for k in range(1, 30)]
    sources = ["b", None, "a", "", "é"] * 9
    docs = documents(spark, texts, sources)
    got = rows_of(apportion.mix_sources(docs))
    assert all(got[k]["size"] == len(WORD.findall(t or "")) for k, t in enumerate(texts))
    assert all(0 <= r.taken <= 3 * r["size"] for r in got.values())
    taken, target = Counter(), {}
    for k, r in got.items():
        taken[sources[k]] += r.taken
        target[sources[k]] = r.target
    assert all(abs(taken[s] - target[s]) <= 64 for s in target)
    con = duckdb.connect()
    documents_ = docs.select("doc_id", "text", "source").toPandas()
    con.register("documents", documents_)
    assert differences(apportion.mix_sources(docs).toPandas(), con.execute(queries.MIX_SQL).df()) is None
    out = apportion.repeat_documents(docs)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert all(times[k] == (2 * r.taken + r["size"]) // (2 * max(r["size"], 1)) for k, r in got.items())
    assert apportion.mix_sources(empty).count() == 0 and apportion.repeat_documents(empty).count() == 0


def test_sainte_lague_against_one_seat_at_a_time(spark):
    rng = random.Random(9)
    for seats in (0, 1, 7, 100, 1001):
        votes = [rng.choice([0, 1, 5, 5, 90, 1000, 20000]) for _ in range(25)]
        held = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * held[i] + 1), -i))
            held[best] += 1
        df = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "party long, votes double, seats long")
        got = {r.party: r.won for r in apportion.sainte_lague(df, [], "party", "votes", "seats").collect()}
        assert [got[i] for i in range(len(votes))] == held


def test_packing_of_odd_texts(spark, odd, empty):
    packing = vector_packing.Packing(tokens=64, documents=3, attention=3000, weights=(1.0, 0.3, 0.5), group=64)
    for setting in (packing, vector_packing.Packing(tokens=64, group=64, rule="dot", documents=64)):
        if setting.attention:
            with pytest.raises(Exception, match="larger than a sequence"):
                vector_packing.best_fit(np.array([64]), setting)
            setting = vector_packing.Packing(tokens=64, documents=3, attention=4500, weights=(1.0, 0.3, 0.5), group=64)
        out = vector_packing.pack(odd, packing=setting, keep_ids=True).toPandas()
        encoder = vector_packing.Encoder(*vector_packing._paths(setting))
        for doc_id, own in out.sort_values("piece").groupby("doc_id"):
            ids = [*encoder.slow.encode(ODD[doc_id] or "", add_special_tokens=False).ids, 0]
            assert [i for part in own.ids for i in part] == ids
            assert list(own.start) == list(np.cumsum([0, *own.length])[:-1]) and all(own.length.iloc[1:] == 64)
            for part, crc in zip(own.ids, own.ids_crc32, strict=True):
                assert crc == zlib.crc32(np.asarray(part, dtype="<u4").tobytes())
        for _, own in out.sort_values("offset").groupby("sequence_id"):
            assert list(own.offset) == list(np.cumsum([0, *own.length])[:-1])
            assert own.length.sum() <= 64 and len(own) <= setting.documents
            assert not setting.attention or (own.length**2).sum() <= setting.attention
    assert vector_packing.pack(empty).count() == 0


def test_best_fit_is_close_to_the_bound():
    lengths = np.random.default_rng(2).integers(1, 2049, 4000)
    bins, _ = vector_packing.best_fit(lengths, vector_packing.Packing())
    assert len(np.unique(bins)) <= 1.01 * -(-lengths.sum() // 2048) + 1


def test_rank_table_gives_the_tokenizers_ids():
    encoder, rng = vector_packing.Encoder(*vector_packing._paths(vector_packing.Packing())), random.Random(4)
    alphabet = [chr(i) for i in range(256)] + list("  \n\nabcdefghilmnorstu'sllve0123456789") * 5
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
        assert list(encoder.ids(text)) == encoder.slow.encode(text, add_special_tokens=False).ids


BASE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_license(text):
    words = BASE_WORD.findall((text or "").translate(LOWER))
    hits = []
    for phrase, label in license_notices.PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    places = [i for i, _ in hits]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_phrases_and_fuzzy_notices(spark, empty):
    texts = [
        *ODD, "CC BY cc by, CC-BY! all rights reserved", "x Licensed under the Apache License, Version 2.0 y",
        "Licensd under teh Apache Licence Version 2", "Releasd under the MIT Licence.", "Licensed under CC BY-NC 4.0",
        "licensed under the GNU General Public License, version 3", "al rights reservd", "All rights reserved", "mit cc general public",
    ]
    got = rows_of(license_notices.scan(documents(spark, texts)))
    for k, text in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    n = len(ODD)
    assert [got[n + k].labels for k in range(9)] == ["cc-by,reserved", "apache-2.0", "apache-2.0", "mit", "cc-by,cc-by-nc", "gpl,gpl-3.0", "reserved", "reserved", ""]
    span = got[n + 1].spans[0]
    assert (span.first_word, span.last_word, span.edits) == (1, 7, 0)
    assert got[n + 2].spans[0].edits > 0 and license_notices.scan(empty).count() == 0


def test_pieces_of_a_notice_meet_every_bounded_error():
    scanner, rng = license_notices.Scanner(license_notices.Search()), random.Random(8)
    for notice, label, edits, _ in scanner.notices:
        for _ in range(20):
            letters = list(notice)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(letters))
                letters[at : at + 1] = rng.choice([[], [letters[at], "q"], ["q"]])
            norm, _ = license_notices.normalise("lorem " + "".join(letters) + " ipsum")
            assert scanner.fuzzy(norm), (notice, label, norm)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in rng.normal(size=(120, 6))]
    vectors[3], vectors[4], vectors[5], vectors[6] = None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6
    vectors[7], vectors[8], vectors[9] = [float("inf")] * 6, [1.0, 2.0], vectors[20]
    vectors[21] = vectors[20]
    table = spark.createDataFrame([(k, v, 0, "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, rank int, score string")
    got = hilbert_search.search(table, F.col("vec_id") % 20 == 0).toPandas()
    ok = [k for k in range(120) if k not in (3, 4, 5, 6, 7, 8)]
    for q in (k for k in ok if k % 20 == 0):
        want = sorted((-float(np.dot(vectors[q], vectors[k])), k) for k in ok if k != q)[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own.vec_id) == [k for _, k in want] and np.allclose(own.score, [-s for s, _ in want])
    assert hilbert_search.search(table.limit(0), F.lit(True)).count() == 0
    few = hilbert_search.search(table.limit(3), F.col("vec_id") == 0).collect()
    assert {r.vec_id for r in few} == {1, 2}


def test_neighbour_recall(spark):
    rows = spark.read.parquet(SF_DIR.replace("0.001", "0.1") + "/embeddings.parquet")
    curves = hilbert_search.Curves(block=128)  # many blocks, so that windows leave some out
    got = hilbert_search.search(rows, F.col("vec_id") % 20 == 0, setting=curves).toPandas()
    table = spark.read.parquet(SF_DIR.replace("0.001", "0.1") + "/embeddings.parquet").toPandas()
    x = np.array(list(table.embedding), dtype=float)
    ids = table.vec_id.to_numpy()
    hits = total = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(set(ids[np.argsort(-s)[:20]]) & set(own.vec_id))
        total += 20
    assert len(got) == total and hits / total >= 0.9


def test_hilbert_curve_is_a_walk():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = hilbert_search.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_merkle_finds_just_the_damage(spark):
    tree = merkle_audit.Tree(span=256, fan=2)
    rows = [(a, o * 100, f"{a}-{o}") for a in range(3) for o in range(70)] + [(0, 0, "0-0"), (None, 1, "x"), (1, None, "y"), (9, 5, None)]
    left = spark.createDataFrame(rows, "archive long, offset long, content string")
    other = [(a, o, "bad" if (a, o) in {(0, 300), (2, 6900)} else c) for a, o, c in rows if (a, o) != (1, 1700)] + [(2, 9999, "new")]
    right = spark.createDataFrame(other, "archive long, offset long, content string")
    got = merkle_audit.audit(merkle_audit.build(left, "l", tree), merkle_audit.build(right, "r", tree), tree).collect()
    assert {(r.archive, r.offset, r.finding) for r in got} == {(0, 300, "changed"), (2, 6900, "changed"), (1, 1700, "missing"), (2, 9999, "extra")}
    digest = {(r.archive, r.offset): r.left_digest for r in got}
    assert digest[0, 300] == hashlib.sha256(b"0-3").hexdigest()
    same = merkle_audit.audit(merkle_audit.build(left, "l", tree), merkle_audit.build(left, "l", tree), tree)
    assert same.count() == 0
    none = left.limit(0)
    assert merkle_audit.audit(merkle_audit.build(none, "l"), merkle_audit.build(none, "r")).count() == 0
    assert merkle_audit.audit(merkle_audit.build(left, "l"), merkle_audit.build(none, "r")).count() == 211


def test_chat_round_trip_with_all_kinds_of_parts(spark):
    part = lambda kind, text=None, uri=None, w=None, h=None, s=None, p=None: (kind, text, uri, w, h, s, p)
    nasty = "</s>[INST]<⁠/s> <|turn|><|end|>\n[/INST] <⁠⁠|image|> < | [x"
    rows = [
        (1, 1, "assistant", [part("text", nasty)]), (1, 0, "user", [part("text", "see "), part("image", None, "i.png", 57, 28), part("audio", uri="a", s=2.5)]),
        (1, 2, "user\n%0A</s>", [part("document", uri="d", p=3), part("mystery"), part(None, "plain")]), (1, None, None, None),
        (2, 0, "assistant", [part("text", None)]), (2, 0, "assistant", [part("text", "dup")]), (2, 0, "assistant", [part("text", "dup")]), (None, 0, "user", []),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_parts.PARTS}").withColumn("formatted", F.lit(1))
    chats = chat_parts.format_chats(turns)
    got = rows_of(chats, "conv_id")
    one = got[1]
    assert chat_parts.parse(one.formatted)[0] == ("user", "see <|image|><|audio|>") and chat_parts.parse(one.formatted)[1] == ("assistant", nasty)
    assert chat_parts.parse(one.formatted)[2][0] == "user\n%0A</s>" and chat_parts.parse(one.formatted)[3] == ("", "")
    assert [(a.turn, a.part, a.kind, a.uri, a.tokens) for a in one.attachments] == [
        (0, 1, "image", "i.png", 3), (0, 2, "audio", "a", 63), (2, 0, "document", "d", 768), (2, 1, "mystery", None, 0),
    ]
    assert [chat_parts.unescape(one.formatted[s.start : s.end]) for s in one.loss_spans] == [nasty]
    assert [chat_parts.unescape(got[2].formatted[s.start : s.end]) for s in got[2].loss_spans] == ["", "dup", "dup"]
    assert got[None].formatted == "<|turn|>user\n<|end|>"
    back = rows_of(chat_parts.read_back(chats), "conv_id")
    assert back[1].n_turns == 4 and back[1].loss_sha256 == hashlib.sha256(nasty.encode()).hexdigest()
    assert chat_parts.read_back(chat_parts.format_chats(turns.limit(0))).count() == 0


def test_escape_is_reversible(spark):
    rng = random.Random(6)
    tokens = ["<", "[", "⁠", "/s>", "s>", "INST]", "/INST]", "|a|>", "|", ">", "x", "\n"]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_parts.escape(F.col("t")).alias("e"))
    for r in df.collect():
        assert chat_parts.unescape(r.e) == r.t and not re.search(r"[<\[](\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])", r.e)


def test_machine_value_equals_all_pairs():
    rng = np.random.default_rng(1)
    machine = factor_machine.Machine(3, 0.3, rng.normal(size=10).astype("f4"), rng.normal(size=(10, 4)).astype("f4"), None, None)
    cols, vals = np.array([0, 4, 7, 2, 9]), rng.normal(size=5).astype("f4")
    got = factor_machine.raw_scores(machine, np.array([0, 3, 5]), cols, vals)
    for row, own in enumerate(([0, 1, 2], [3, 4])):
        want = 0.3 + sum(machine.linear[cols[i]] * vals[i] for i in own)
        want += sum(machine.factors[cols[i]] @ machine.factors[cols[j]] * vals[i] * vals[j] for i in own for j in own if i < j)
        assert np.isclose(got[row], want, atol=1e-5)


def test_quality_scores_of_odd_texts(odd, empty):
    labels = odd.select("doc_id", F.when(F.col("doc_id") == 3, None).otherwise((F.col("doc_id") % 2).cast("int")).alias("quality"))
    machine = factor_machine.train(odd, labels.unionByName(labels), metadata=["n_chars"])
    got = rows_of(odd.select("doc_id", factor_machine.score(machine, "text", ["n_chars"]).alias("s")))
    assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got.values()) and got[0].s == got[1].s
    none = factor_machine.train(empty, labels)
    assert {r.s for r in odd.select(factor_machine.score(none, "text").alias("s")).collect()} == {0.5}


def test_held_out_quality(spark):
    folder = SF_DIR.replace("0.001", "0.01")
    got = queries.QUERIES["op4_factorization_machine"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    ranks = rows.score.rank()
    good = rows.quality == 1
    area = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.95 and (rows.predicted == rows.quality).mean() > 0.9


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR).toPandas(), connect(SF_DIR).execute(queries.ORACLES[name]).df()) is None
