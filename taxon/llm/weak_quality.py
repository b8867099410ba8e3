"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains. Expectation-maximisation estimates how often each rule
votes how under either class; the posterior probability of good then decides, instead of asking that
every rule passes. Rules are column expressions, the estimation works on counts of vote patterns, and
everything runs as DataFrame operations. Base rules come first: a text that fails them is out, and the
estimate rests on the texts that pass them.

Defined results: a null or empty text has no words, fails the base rules and is not kept. An empty
table gives an empty result. Repeated rows are judged alike and count as often as they occur.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxon.llm.common import SPACES, private, written

SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_stops", "n_digits"]


def _count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def with_repeat_words(docs: DataFrame, words: str, out: str, size: int = 5) -> DataFrame:
    """Adds the number of words that lie in a window of ``size`` words found twice or more in the array.

    Windows are compared by a 64-bit hash of their words. Only texts in which a window repeats pay for
    the sort that finds the places. Each step is a column of its own, since what a lambda function names
    is evaluated for every element.
    """
    hashes, ordered, twice = private("hashes"), private("ordered"), private("twice")
    count = F.greatest(F.size(words) - (size - 1), F.lit(0))
    return (
        docs.withColumn(hashes, F.transform(F.slice(words, 1, count), lambda _, i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])))
        .withColumn(
            ordered,
            F.when(
                F.size(F.array_distinct(hashes)) < F.size(hashes),
                F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .withColumn(
            twice,
            F.filter(
                ordered,
                lambda x, k: F.coalesce(x["h"] == F.get(ordered, k - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(ordered, k + 1)["h"], F.lit(False)),
            ),
        )
        .withColumn(
            out,
            F.coalesce(
                F.aggregate(
                    F.array_sort(F.transform(twice, lambda x: x["i"])),
                    F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")),
                    lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")),
                    lambda a: a["n"],
                ),
                F.lit(0),
            ).cast("long"),
        )
        .drop(hashes, ordered, twice)
    )


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The rows with their text statistics under private names, by the names of ``STATISTICS``."""
    t, w, lines, l_words = private("t"), private("w"), private("lines"), private("lw")
    names = {k: private(k) for k in STATISTICS}
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumns(
        {w: _words(F.col(t)), lines: F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)}
    ).withColumn(l_words, F.array_distinct(w))
    out = with_repeat_words(out, w, names["n_repeat_words"])
    # Letters A-Z, digits and common function words of the languages in view.
    stops = ["the", "of", "and", "to", "in", "der", "die", "und", "das", "le", "la", "les", "de", "et", "el", "los", "que", "en"]
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": _count_chars(F.col(t), SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_lines": F.size(lines),
        "n_distinct_words": F.size(l_words),
        "n_upper": _count_chars(F.col(t), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_stops": F.size(F.array_intersect(l_words, F.array(*[F.lit(x) for x in stops]))),
        "n_digits": _count_chars(F.col(t), "0123456789"),
    }
    return out.withColumns({names[k]: v.cast("long") for k, v in found.items()}).drop(t, w, lines, l_words), names


@dataclass(frozen=True)
class Rule:
    """Votes bad above ``bad``, good up to ``good``, and abstains between them."""

    name: str
    measure: str  # SQL over the statistics
    good: float
    bad: float


#: Documented parameters. A measure that is null (its base is empty) abstains.
RULES = [
    Rule("symbol_share", "n_symbols / nullif(n_words, 0)", 0.1, 0.3),
    Rule("symbol_chars", "n_symbols / nullif(word_chars, 0)", 0.02, 0.1),
    Rule("repeat_share", "n_repeat_words / nullif(n_words, 0)", 0.1, 0.2),
    Rule("dup_line_share", "n_dup_lines / nullif(n_lines, 0)", 0.3, 0.5),
    Rule("upper_share", "n_upper / nullif(word_chars, 0)", 0.15, 0.4),
    Rule("word_length", "abs(word_chars / nullif(n_words, 0) - 6)", 2.5, 6.0),
    Rule("same_word_share", "1 - n_distinct_words / nullif(least(n_words, 400), 0)", 0.6, 0.85),
    Rule("digit_share", "n_digits / nullif(word_chars, 0)", 0.1, 0.3),
    Rule("shortness", "30 - n_words", 0.0, 20.0),
    Rule("missing_stop_words", "case when n_words >= 40 then 2 - n_stops end", 0.0, 1.0),
]


def votes(names: dict[str, str], rules: list[Rule]) -> Column:
    """One character for each rule: ``+`` good, ``-`` bad, ``0`` abstains."""

    def one(rule: Rule) -> Column:
        value = F.expr(re.sub(r"\w+", lambda m: names.get(m.group(), m.group()), rule.measure))
        return F.when(value > rule.bad, "-").when(value <= rule.good, "+").otherwise("0")

    return F.concat(*[one(r) for r in rules])


def base_failed(names: dict[str, str]) -> Column:
    n = F.col(names["n_words"])
    return (n < 10) | (100 * F.col(names["n_repeat_words"]) > 20 * n)


@dataclass(frozen=True)
class RuleModel:
    """P(good), and for each rule the chance that its vote is ``+`` under good and under bad.

    Whether a rule votes at all says nothing; an abstention leaves the odds as they are.
    """

    prior: float
    passes: tuple[tuple[float, float], ...]

    def posterior(self, pattern: Column) -> Column:
        """Probability of good given the votes."""
        log_odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, (good, bad) in enumerate(self.passes):
            vote = F.substring(pattern, k + 1, 1)
            log_odds = log_odds + F.when(vote == "+", math.log(good / bad)).when(vote == "-", math.log((1 - good) / (1 - bad))).otherwise(0.0)
        return 1 / (1 + F.exp(-log_odds))


def fit_rules(patterns: DataFrame, n_rules: int, steps: int = 25, strength: float = 20.0) -> RuleModel:
    """Estimate the rules from counts of vote patterns, ``pattern, n``.

    There are at most 3**n_rules patterns, whatever the size of the input. The estimate starts at rules
    that seldom accuse a good text and often pass a bad one, since each looks for one fault only. That
    belief counts like ``strength`` observations, so that a rule that never votes keeps it and no rule
    turns against its meaning on little evidence.
    """
    prior, belief = 0.8, (0.98, 0.62)
    total = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + value(x))

    def log_odds(x: Column, state: Column) -> Column:
        """Sum over the rules of what their votes say, from the prior on."""
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(n_rules - 1)),
            F.log(state["prior"]) - F.log(1 - state["prior"]),
            lambda acc, k: acc
            + F.when(F.get(x["votes"], k) == "+", F.log(F.get(state["good"], k) / F.get(state["bad"], k)))
            .when(F.get(x["votes"], k) == "-", F.log((1 - F.get(state["good"], k)) / (1 - F.get(state["bad"], k))))
            .otherwise(0.0),
        )

    def expect(state: Column) -> Column:
        """Each pattern's count, split into good and bad."""
        share = lambda x: 1 / (1 + F.exp(-log_odds(x, state)))
        split = F.transform(F.col("patterns"), lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * share(x)).alias("g")))
        return F.struct(state["prior"].alias("prior"), state["good"].alias("good"), state["bad"].alias("bad"), split.alias("split"))

    def maximise(state: Column) -> Column:
        """The parameters that the split counts, and the belief, make most likely."""

        def rates(part, own: float) -> Column:
            def rate(k: Column) -> Column:
                vote = lambda x: F.get(x["votes"], k)
                passed = total(state["split"], lambda x: F.when(vote(x) == "+", part(x)).otherwise(0.0))
                voted = total(state["split"], lambda x: F.when(vote(x) != "0", part(x)).otherwise(0.0))
                return (passed + strength * own) / (voted + strength)

            return F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), rate)

        good, n = total(state["split"], lambda x: x["g"]), total(state["split"], lambda x: x["n"])
        return F.struct(
            ((good + strength * prior) / (n + strength)).alias("prior"),
            rates(lambda x: x["g"], belief[0]).alias("good"),
            rates(lambda x: x["n"] - x["g"], belief[1]).alias("bad"),
            state["split"].alias("split"),
        )

    one = F.struct(F.split("pattern", "").alias("votes"), F.col("n").cast("double").alias("n"))
    listed = patterns.agg(F.array_sort(F.collect_list(one)).alias("patterns"))  # at most 3**n_rules entries
    start = F.struct(
        F.lit(prior).alias("prior"), F.array_repeat(F.lit(belief[0]), n_rules).alias("good"), F.array_repeat(F.lit(belief[1]), n_rules).alias("bad"),
        F.transform("patterns", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), F.lit(0.0).alias("g"))).alias("split"),
    )
    turns = F.sequence(F.lit(1), F.lit(2 * steps))
    fitted = F.aggregate(turns, start, lambda state, i: F.when(i % 2 == 1, expect(state)).otherwise(maximise(state)))
    row = listed.select(fitted.alias("f")).select("f.prior", "f.good", "f.bad").first()
    return RuleModel(row["prior"], tuple(zip(row["good"], row["bad"], strict=True)))


def judged(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> tuple[DataFrame, dict[str, str]]:
    """The rows with statistics and the vote pattern (under ``votes``), by private names."""
    out, names = with_statistics(docs, text)
    names = names | {"votes": private("votes")}
    return out.withColumn(names["votes"], votes(names, rules)), names


def patterns_of(table: DataFrame, column: str) -> DataFrame:
    """Counts of vote patterns as a small table."""
    return written(table.groupBy(F.col(column).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote-patterns")


def assess(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, posterior and verdict of each row. Texts are read once."""
    out, names = judged(docs, text, rules)
    narrow = written(out.select(F.col(key).alias("doc_id"), *[F.col(v).alias(k) for k, v in names.items()]), "quality-votes")
    failed = base_failed({k: k for k in names})
    model = fit_rules(patterns_of(narrow.filter(~failed), "votes"), len(rules))
    quality = model.posterior(F.col("votes"))
    return narrow.withColumns({"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= threshold)})


def keep_good(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES, threshold: float = 0.5) -> DataFrame:
    """Rows that pass the base rules and whose posterior reaches the threshold; columns as they came.

    Votes are computed twice, once for the estimate and once for the decision: that is cheaper than a
    join that would move every text.
    """
    out, names = judged(docs, text, rules)
    # A filter on computed columns would be pushed below them, its lambda functions then evaluating whole
    # arrays for each element. One that also reads a row number stays where it is.
    row = private("row")
    out = out.withColumn(row, F.monotonically_increasing_id())
    passed = (F.col(row) >= 0) & ~base_failed(names)
    model = fit_rules(patterns_of(out.filter(passed), names["votes"]), len(rules))
    good = passed & (model.posterior(F.col(names["votes"])) >= threshold)
    return out.filter(good).select(*[F.col(f"`{c}`") for c in docs.columns])
