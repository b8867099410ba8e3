"""Licence scan for short notices that may be misspelt.

A notice of m letters that is allowed k edits is split into k + 1 pieces; wherever it occurs with at
most k edits, one piece occurs unchanged (pigeonhole). One automaton looks for the pieces of all
notices at once; around each hit the regex library matches the whole notice with bounded errors, which
verifies the edits and gives the span. Where matches overlap, a longer notice wins over one that lies
within it, then the one with the fewest edits, then the longest. Exact phrases of words are found on the way.

Text is compared as words of ASCII digits, ASCII letters in lower case and all other characters beyond
ASCII, joined by single spaces.

Defined results: a null or empty text has no words, no places and score 0. Repeated rows are scanned
alike. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that must stand word for word, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices of well-known licences (SPDX-like labels), in normalised words.
NOTICES = {
    "licensed under the apache license version 2": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2.0",
    "eclipse public license version 2": "epl-2.0",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons zero": "cc0-1.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "no part of this publication may be reproduced": "reserved",
    "all rights reserved": "reserved",
}

_WORD = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Search:
    """Documented parameters: one edit is allowed for every ``letters_per_edit`` letters, at most ``most``."""

    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    notices: dict[str, str] = field(default_factory=lambda: dict(NOTICES))
    letters_per_edit: int = 9
    most: int = 5


def normalise(text: str) -> tuple[bytes, int]:
    """Words between single spaces, with a space at either end; number of words."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_WORD).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" ", len(words)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice in ``edits + 1`` pieces of nearly equal length, with their places."""
    n = len(notice)
    cuts = [n * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def resolved(found: set[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """``label, start, end, edits`` of matches that do not overlap, of matches that also hold their notice's length."""
    by_start = sorted(found, key=lambda x: x[1])
    starts = [x[1] for x in by_start]
    widest = max((x[2] - x[1] for x in found), default=0)
    most = max((x[3] for x in found), default=0)

    def within_longer(one: tuple[str, int, int, int, int]) -> bool:
        """The edits of the longer match may fall on its ends."""
        near = by_start[bisect_left(starts, one[2] - widest - most) : bisect_right(starts, one[1] + most)]
        return any(x[4] > one[4] and x[1] - x[3] <= one[1] and one[2] <= x[2] + x[3] for x in near)

    kept: list[tuple[int, int, str, int]] = []
    for label, start, end, edits, _ in sorted(found, key=lambda x: (within_longer(x), x[3], x[1] - x[2], x[1], x[0])):
        at = bisect_left(kept, (start,))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
            insort(kept, (start, end, label, edits))
    return [(label, start, end, edits) for start, end, label, edits in kept]


class Scanner:
    """Built once in each Python worker."""

    def __init__(self, search: Search):
        self.search = search
        self.phrases = [(f" {p} ".encode(), label) for p, label in search.phrases.items()]
        self.notices = []
        hooks: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, label) in enumerate(search.notices.items()):
            edits = min(search.most, len(notice) // search.letters_per_edit)
            pattern = regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")
            self.notices.append((notice, label, edits, pattern))
            for at, piece in seeds(notice, edits):
                hooks.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in hooks.items():
            self.automaton.add_word(piece, (len(piece), own))
        self.automaton.make_automaton()

    def base(self, norm: bytes) -> tuple[int, list[int], set[str]]:
        """Places of all phrases: their number, the byte offsets of their first words, the labels."""
        places, labels = [], set()
        for phrase, label in self.phrases:
            at = norm.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = norm.find(phrase, at + 1)
        return len(places), places, labels

    def fuzzy(self, norm: bytes) -> list[tuple[str, int, int, int]]:
        """``label, start, end, edits`` of each verified notice, as offsets in the normalised text."""
        flat = norm.decode("latin-1")  # one character for each byte
        windows: set[tuple[int, int]] = set()
        for end, (size, own) in self.automaton.iter(flat):
            windows.update((k, end + 1 - size - at - self.notices[k][2]) for k, at in own)
        found = set()
        for k, low in windows:  # each alone: the best match of a wider one hides those before it
            notice, label, edits, pattern = self.notices[k]
            m = pattern.search(flat, max(0, low), min(low + len(notice) + 2 * edits, len(flat)))
            if m:
                found.add((label, m.start(), m.end(), sum(m.fuzzy_counts), len(notice)))
        return resolved(found)

    def scan(self, text: str | None) -> tuple:
        norm, n_words = normalise(text or "")
        n_base, places, base = self.base(norm)
        word_at = lambda at: norm.count(b" ", 0, at + 1) - 1
        first = word_at(min(places)) if places else None
        last = word_at(max(places)) if places else None
        spans = self.fuzzy(norm) if n_words else []
        labels = base | {s[0] for s in spans}
        best = max([1.0 if base else 0.0, *(1 - e / max(1, b - a) for _, a, b, e in spans)])
        notes = [{"label": label, "first_word": word_at(a), "last_word": norm.count(b" ", 0, b - 1) - 1, "edits": e} for label, a, b, e in spans]
        return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(best), notes


SPANS = "array<struct<label:string,first_word:int,last_word:int,edits:int>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", search: Search = Search()) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of each row.

    ``spans`` holds the notices that bounded-error matching verified, with their words and edits.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(search)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            out = pd.DataFrame([scanner.scan(t) for t in batch], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    kind = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
    return docs.select(F.col(key).alias("doc_id"), F.pandas_udf(run, kind)(F.col(text)).alias("s")).select("doc_id", "s.*")
