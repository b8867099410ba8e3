"""Language-model scores of documents: marginal likelihood over all subword segmentations.

The units are the pieces of an existing public subword vocabulary (never retrained: its pieces are
taken as they are), its byte pieces for byte fallback, and an end-of-document unit. Their unigram
probabilities are trained here on the corpus by expectation-maximisation: each round weighs every
segmentation of every training word by its current probability (forward and backward recursions in log
space over the word's lattice), sums the expected unit counts, and normalises them with add-one
smoothing. A document's score is log10 of

    P(text) = prod over words w of  sum over segmentations of '▁' + w of  prod p(unit)   *   p(end)

computed by the forward recursion of each word's lattice. A segmentation uses vocabulary pieces and, for
any one character, the vocabulary's pieces of its UTF-8 bytes (so every text has one).

The base score beside it is an add-one unigram over whole words: sum of log10((c + 1) / (N + V + 1)) over
the words and one end token.

Scale: training works on distinct words with their counts (a map-side combined aggregation, so a hot word
is one row); an EM round is one pass over them in Arrow batches (words of one length share numpy arrays),
each batch sending one row per unit it saw, and only unit counts (bounded by the vocabulary) reach the driver. Scoring takes the
documents in blocks bounded by ``block_words`` and ``block_pairs``: a block's distinct words are scored by their
lattices once (not again if the task's previous block had them), and a document keeps the places of its words in the block's list. For the base score a block asks
for the training count of each of its distinct words once, instead of once per document, and the counts come back
to the block; words above a share ``hot_share`` of all training words (at most 1 / ``hot_share`` of them) are
salted over ``salts`` keys, so not even a word of every block meets in one task.

Defined results: null text is empty; an empty text has one token (the end) and the score of the end unit.
Lower-casing covers A-Z only. A null ``doc_id`` is not held out and is learned from. Repeated rows are
separate documents with equal results. Very long texts and words are scored whole. An empty table returns
no rows; with no training rows every unit has the same probability. Columns other than the named ones are
ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from taxon.llm.common import term_table, terms_in, written

# Fixed values of the contract: white space that separates words, lower-casing of A-Z only.
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD_START = "▁"
END = "</s>"


@dataclass(frozen=True)
class Model:
    """Documented parameters: vocabulary file, EM rounds, salting of hot words in the base join, and the distinct
    words and (document, word) pairs after which a block of documents ends (with whole documents).
    """

    vocabulary: str = "piece_bpe_32k.model"
    rounds: int = 3
    hot_share: float = 0.001
    salts: int = 64
    block_words: int = 300_000
    block_pairs: int = 1_500_000


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 2 on division by 7; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def words_of(text: Column) -> Column:
    words = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), WORD_SEPARATOR)
    return F.filter(words, lambda w: w != "")


def vocabulary_units(path: str) -> tuple[list[str], int]:
    """Pieces of the vocabulary (text pieces, then byte pieces as '<0xNN>') and the longest text piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    units = pieces + [f"<0x{b:02X}>" for b in range(256)]
    return units, max(len(p) for p in pieces)


class Lattice:
    """Edges of a word's lattice and the forward and backward recursions over them."""

    def __init__(self, logp: dict[str, float], longest: int):
        self.logp, self.longest = logp, longest
        self._fallback: dict[str, tuple[float, list[str]]] = {}

    def fallback(self, char: str) -> tuple[float, list[str]]:
        found = self._fallback.get(char)
        if found is None:
            units = [f"<0x{b:02X}>" for b in char.encode("utf-8", "surrogatepass")]
            found = self._fallback[char] = (sum(self.logp[u] for u in units), units)
        return found

    def edges(self, s: str) -> list[list[tuple[int, float, list[str]]]]:
        """For every start, (end, log probability, units) of each edge."""
        out = []
        for i in range(len(s)):
            here = [(i + 1, *self.fallback(s[i]))]
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                lp = self.logp.get(s[i:j])
                if lp is not None:
                    here.append((j, lp, [s[i:j]]))
            out.append(here)
        return out

    @staticmethod
    def _add(a: float, b: float) -> float:
        if a == -math.inf:
            return b
        if b == -math.inf:
            return a
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    def forward(self, s: str, edges=None) -> list[float]:
        edges = edges if edges is not None else self.edges(s)
        alpha = [-math.inf] * (len(s) + 1)
        alpha[0] = 0.0
        for i, here in enumerate(edges):
            if alpha[i] == -math.inf:
                continue
            for j, lp, _ in here:
                alpha[j] = self._add(alpha[j], alpha[i] + lp)
        return alpha

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all segmentations of the word's lattice (forward recursion only)."""
        s = WORD_START + word
        n, logp, longest = len(s), self.logp, self.longest
        exp, log1p, inf = math.exp, math.log1p, -math.inf
        alpha = [inf] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            if a == inf:
                continue
            for j in range(i + 1, min(n, i + longest) + 1):
                lp = logp.get(s[i:j]) if j > i + 1 else self.fallback(s[i])[0]
                if j == i + 1 and s[i] in logp:
                    # the one-character piece and the character's byte pieces are two edges
                    v = a + logp[s[i]]
                    b = alpha[j]
                    alpha[j] = v if b == inf else max(b, v) + log1p(exp(-abs(b - v)))
                if lp is None:
                    continue
                v = a + lp
                b = alpha[j]
                alpha[j] = v if b == inf else max(b, v) + log1p(exp(-abs(b - v)))
        return alpha[n]

    def expect(self, word: str, weight: float, into: dict[str, float]) -> None:
        """Add ``weight`` times each unit's expected count over the segmentations of the word."""
        s = WORD_START + word
        edges = self.edges(s)
        alpha = self.forward(s, edges)
        beta = [-math.inf] * (len(s) + 1)
        beta[-1] = 0.0
        for i in range(len(s) - 1, -1, -1):
            for j, lp, _ in edges[i]:
                beta[i] = self._add(beta[i], lp + beta[j])
        total = alpha[-1]
        for i, here in enumerate(edges):
            for j, lp, units in here:
                share = math.exp(alpha[i] + lp + beta[j] - total)
                if share > 0:
                    for u in units:
                        into[u] += weight * share


class Lattices:
    """The recursions of ``Lattice`` for many words at once: words of one length share dense arrays.

    Probabilities are multiplied as they are; words above ``LONGEST_DENSE`` characters and those whose
    probability comes near the smallest double go through ``Lattice``, in log space.
    """

    LONGEST_DENSE = 64
    SMALLEST = 1e-200
    CELLS = 2_000_000

    def __init__(self, logp: dict[str, float], longest: int):
        self.one = Lattice(logp, longest)
        self.longest = longest
        self.units = list(logp)
        self.ids = {u: k for k, u in enumerate(self.units)}
        self.p = np.exp(np.fromiter(logp.values(), dtype=float, count=len(logp)))
        # prefix tree of the units: sorted (node, code point) -> next node, and the unit that ends at a node
        step: dict[int, int] = {}
        ends = {}
        for k, unit in enumerate(self.units):
            if len(unit) <= longest:
                node = 0
                for char in unit:
                    node = step.setdefault(node << 21 | ord(char), len(step) + 1)
                ends[node] = k
        self.keys = np.sort(np.fromiter(step, dtype=np.int64, count=len(step)))
        self.next = np.fromiter((step[int(k)] for k in self.keys), dtype=np.int64, count=len(step))
        self.unit_at = np.full(len(step) + 1, -1, dtype=np.int64)
        self.unit_at[list(ends)] = list(ends.values())

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``words``, code points): words of one length, with the word start in front."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        for n in np.unique(lengths):
            if n > self.LONGEST_DENSE:
                break
            at = order[np.searchsorted(lengths[order], n) : np.searchsorted(lengths[order], n, "right")]
            width = max(1, self.CELLS // int(n * min(n, self.longest)))
            for part in (at[k : k + width] for k in range(0, len(at), width)):
                text = "".join(WORD_START + words[k] for k in part)
                yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), n).astype(np.int64)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, length and unit of every piece found in the words."""
        n = codes.shape[1]
        flat, at = codes.ravel(), np.arange(codes.size)
        node, found = np.zeros(codes.size, dtype=np.int64), []
        for length in range(1, min(n, self.longest) + 1):
            inside = at % n + length <= n
            at, node = at[inside], node[inside]
            key = node << 21 | flat[at + length - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            at, node = at[known], self.next[place[known]]
            unit = self.unit_at[node]
            ended = unit >= 0
            found.append((at[ended], np.full(int(ended.sum()), length), unit[ended]))
        at, length, unit = (np.concatenate(x) for x in zip(*found))
        return at // n, at % n, length, unit

    def forward(self, codes: np.ndarray):
        """Edges, characters with their byte probabilities, probability of every step, forward sums."""
        words, n = codes.shape
        word, start, length, unit = self.edges(codes)
        chars, which = np.unique(codes, return_inverse=True)
        fall = np.exp([self.one.fallback(chr(c))[0] for c in chars])[which.reshape(words, n)]
        step = np.zeros((n, int(length.max(initial=1)), words))
        step[start, length - 1, word] = self.p[unit]
        step[:, 0, :] += fall.T
        alpha = np.zeros((n + 1, words))
        alpha[0] = 1.0
        for i in range(n):
            m = min(step.shape[1], n - i)
            alpha[i + 1 : i + 1 + m] += alpha[i] * step[i, :m]
        return (word, start, length, unit), (chars, which.reshape(words, n), fall), step, alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """``Lattice.log_probability`` of every word."""
        out = np.full(len(words), -math.inf)
        for part, codes in self.groups(words):
            total = self.forward(codes)[3][-1]
            fit = total > self.SMALLEST
            out[part[fit]] = np.log(total[fit])
        for k in np.flatnonzero(out == -math.inf):
            out[k] = self.one.log_probability(words[k])
        return out

    def expect(self, words: list[str], weights: np.ndarray) -> dict[str, float]:
        """Sum of ``Lattice.expect`` over the words."""
        sums = np.zeros(len(self.units))
        left = np.ones(len(words), dtype=bool)
        for part, codes in self.groups(words):
            (word, start, length, unit), (chars, which, fall), step, alpha = self.forward(codes)
            n = codes.shape[1]
            beta = np.zeros_like(alpha)
            beta[n] = 1.0
            for i in range(n - 1, -1, -1):
                m = min(step.shape[1], n - i)
                beta[i] = (step[i, :m] * beta[i + 1 : i + 1 + m]).sum(axis=0)
            fit = alpha[-1] > self.SMALLEST
            left[part[fit]] = False
            scale = np.divide(weights[part], alpha[-1], out=np.zeros(len(part)), where=fit)
            share = alpha[start, word] * self.p[unit] * beta[start + length, word] * scale[word]
            sums += np.bincount(unit, weights=share, minlength=len(sums))
            by_char = np.bincount(which.ravel(), weights=(alpha[:-1] * fall.T * beta[1:] * scale).T.ravel(), minlength=len(chars))
            for char, value in zip(chars, by_char):
                for u in self.one.fallback(chr(char))[1]:
                    sums[self.ids[u]] += value
        into: dict[str, float] = defaultdict(float)
        for k in np.flatnonzero(left):
            self.one.expect(words[k], float(weights[k]), into)
        for k in np.flatnonzero(sums):
            into[self.units[k]] += float(sums[k])
        return into


# separators and A-Z in the bytes of a text, as in ``words_of``
TABLE = term_table([0x20, *range(0x09, 0x0E)])
TERMS_AT_ONCE = 500_000
ROWS_AT_ONCE = 2_000


def _strings(words: list[bytes | None]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of some texts, not yet summed over all."""
    into: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([_strings(list(into)), pa.array(into.values(), pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            into.update(terms_in(text.as_py(), TABLE))
            if len(into) >= TERMS_AT_ONCE:
                yield out()
                into.clear()
    yield out()


def _document_blocks(batches: Iterator[pa.RecordBatch], lattices: Lattices, setting: Model) -> Iterator[pa.RecordBatch]:
    """The rows of ``word_blocks``: blocks of whole documents, then the distinct words of each block."""
    number = TaskContext.get().partitionId() << 32
    kept, ids, scored = [], {}, {}
    at, tf, distinct = array("i"), array("i"), array("q")

    def out() -> Generator[pa.RecordBatch, None, dict[bytes, float]]:
        words = _strings(list(ids))
        lp = np.fromiter((scored.get(w, math.nan) for w in ids), dtype=float, count=len(ids))
        new = np.flatnonzero(np.isnan(lp))
        lp[new] = lattices.log_probability(words.take(pa.array(new)).to_pylist()) / math.log(10)
        docs, n_words, total = np.array(distinct), len(words), np.array(tf, dtype=float)
        doc = np.repeat(np.arange(len(docs)), docs)
        sums = [np.bincount(doc, weights=x, minlength=len(docs)) for x in (total, total * lp[np.array(at)])]
        offsets = pa.array(np.concatenate(([0], np.cumsum(docs))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.array(x))) for x in (at, tf)]
        ids_kept = [pa.concat_arrays([b.column(c) for b in kept]) for c in ("doc_id", "held_out")]
        columns = [*ids_kept, pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(float)), *lists]
        blank = [pa.nulls(n_words, x.type) for x in columns]
        none = [pa.nulls(len(docs), t) for t in (pa.int32(), pa.string())]
        places = pa.array(np.arange(n_words, dtype=np.int32))
        names = ["block", "doc_id", "held_out", "n_words", "words_score", "at", "tf", "place", "word"]
        for n, rows in ((len(docs), [*columns, *none]), (n_words, [*blank, places, words])):
            made = pa.record_batch([pa.array(np.full(n, number)), *rows], names=names)
            yield from (made.slice(k, ROWS_AT_ONCE) for k in range(0, n, ROWS_AT_ONCE))
        return dict(zip(ids, lp.tolist()))  # the next block of the task scores only words that this one had not

    for batch in batches:
        begun = 0
        for k, text in enumerate(batch.column("text").cast(pa.binary()), 1):
            found = Counter(terms_in(text.as_py(), TABLE))
            at.extend([ids.setdefault(w, len(ids)) for w in found])
            tf.extend(found.values())
            distinct.append(len(found))
            if len(ids) >= setting.block_words or len(at) + len(distinct) >= setting.block_pairs:
                kept.append(batch.select(["doc_id", "held_out"]).slice(begun, k - begun))
                scored = yield from out()
                number, begun, kept, ids = number + 1, k, [], {}
                at, tf, distinct = array("i"), array("i"), array("q")
        if begun < batch.num_rows:
            kept.append(batch.select(["doc_id", "held_out"]).slice(begun))
    if kept:
        yield from out()


def _normalised(counts: dict[str, float], units: list[str]) -> dict[str, float]:
    total = sum(counts.get(u, 0.0) for u in units) + len(units)
    return {u: math.log((counts.get(u, 0.0) + 1.0) / total) for u in units}


def train(docs: DataFrame, setting: Model = Model(), text: str = "text") -> dict:
    """Word counts of the training rows (a written table) and the trained unit log probabilities."""
    import public_tokenizers

    units, longest = vocabulary_units(public_tokenizers.path(setting.vocabulary))
    units = units + [END]
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_batch_counts, "word string, c long")
    counted = counted.groupBy("word").agg(F.sum("c").alias("c"))
    counted = written(counted, "lattice-word-counts")
    n_docs = docs.count()
    logp = {u: -math.log(len(units)) for u in units}
    for _ in range(setting.rounds):
        current = dict(logp)

        def expected(batches: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            lattices = Lattices(current, longest)
            for batch in batches:
                into = lattices.expect(batch["word"].tolist(), batch["c"].to_numpy(dtype=float))
                yield pd.DataFrame({"unit": list(into.keys()), "e": list(into.values())})

        sums = counted.mapInPandas(expected, "unit string, e double").groupBy("unit").agg(F.sum("e").alias("e"))
        found = {r["unit"]: r["e"] for r in sums.collect()} | {END: float(n_docs)}
        logp = _normalised(found, units)
    return {"logp": logp, "longest": longest, "counts": counted, "n_docs": n_docs}


def word_blocks(docs: DataFrame, model: dict, setting: Model = Model(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents, written once: a row per document (number of words, lattice score of all its words, places of
    its distinct words in the block's list with their counts), and a row (place, word) per distinct word of the block.
    """
    logp, longest = model["logp"], model["longest"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    columns = StructType().add("block", "long").add("doc_id", rows.schema["doc_id"].dataType).add("held_out", "boolean")
    columns = columns.add("n_words", "long").add("words_score", "double").add("at", ArrayType(IntegerType())).add("tf", ArrayType(IntegerType()))
    columns = columns.add("place", "integer").add("word", "string")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _document_blocks(batches, Lattices(logp, longest), setting)

    return written(rows.mapInArrow(blocks, columns), "lattice-word-blocks")


def score(docs: DataFrame, model: dict, setting: Model = Model(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Each distinct word of a block of documents is scored by its lattice once and asks once for its training count.
    """
    logp, counted, n_docs = model["logp"], model["counts"], model["n_docs"]
    stats = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens = int(stats["n"]) + n_docs
    distinct = int(stats["v"]) + (1 if n_docs else 0)
    denominator = train_tokens + distinct + 1

    blocks = word_blocks(docs, model, setting, doc_id, text)
    documents = blocks.filter(F.col("word").isNull()).drop("place", "word")
    places = blocks.filter(F.col("word").isNotNull()).select("word", "block", "place")

    # words above hot_share of the training words (at most 1 / hot_share of them) are salted over several keys
    threshold = max(1, int(setting.hot_share * train_tokens))
    hot = counted.filter(F.col("c") >= threshold).select("word", F.lit(True).alias("hot"))
    salt_of = F.when(F.col("hot"), F.pmod(F.xxhash64("block"), F.lit(setting.salts))).otherwise(F.lit(0))
    keyed_places = places.join(F.broadcast(hot), "word", "left").withColumn("salt", salt_of).drop("hot")
    salts = F.when(F.col("c") >= threshold, F.sequence(F.lit(0), F.lit(setting.salts - 1))).otherwise(F.array(F.lit(0)))
    keyed = counted.withColumn("salt", F.explode(salts))
    # training words are one row a key, so each task's share of them is hashed, nothing sorted
    known = keyed_places.join(keyed.hint("shuffle_hash"), ["word", "salt"]).select(F.col("block").alias("of_block"), "place", "c")

    end_base = math.log10((n_docs + 1) / denominator)
    end_score = logp[END] / math.log(10)

    def scored(docs: pa.Table, known: pa.Table) -> pa.Table:
        """The documents of one block with the counts of its known words."""
        at, tf = (docs[c].combine_chunks() for c in ("at", "tf"))
        doc = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
        at, tf = at.flatten().to_numpy(), tf.flatten().to_numpy()
        c = np.zeros(int(at.max(initial=-1)) + 1)
        c[known["place"].to_numpy()] = known["c"].to_numpy()
        base = tf * np.log10((c + 1) / denominator)[at]
        n_known, words_base = (np.bincount(doc, weights=x, minlength=docs.num_rows) for x in (tf * (c > 0)[at], base))
        return pa.table({
            "doc_id": docs["doc_id"],
            "held_out": docs["held_out"],
            "n_tokens": docs["n_words"].to_numpy() + 1,
            "n_known": n_known.astype(np.int64) + (1 if n_docs else 0),
            "train_tokens": np.full(docs.num_rows, train_tokens, dtype=np.int64),
            "base_score": words_base + end_base,
            "score": docs["words_score"].to_numpy() + end_score,
        })

    columns = StructType().add("doc_id", documents.schema["doc_id"].dataType).add("held_out", "boolean")
    columns = columns.add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")
    joined = documents.groupBy("block").cogroup(known.groupBy("of_block"))
    return joined.applyInArrow(scored, columns)


def lattice_search_space(word: str, logp: dict[str, float], longest: int) -> list[list[str]]:
    """Every segmentation of a word's lattice, unit by unit (for tests on short words)."""
    lattice = Lattice(logp, longest)
    s = WORD_START + word
    edges = lattice.edges(s)
    found: list[list[str]] = []

    def walk(i: int, path: list[str]) -> None:
        if i == len(s):
            found.append(path)
            return
        for j, _, units in edges[i]:
            walk(j, path + units)

    walk(0, [])
    return found

