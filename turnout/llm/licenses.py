"""Licence scan: fuzzy search for short notices by exact seeds and bounded-error matching.

A notice that occurs with at most k errors (letters changed, dropped or added) contains at
least one of k + 1 parts of it unchanged (pigeonhole). The parts of all notices are sought
together by one Aho-Corasick automaton; around each hit the `regex` library's bounded-error
matching looks for the whole notice and gives its span. Both work on the words of a text
joined by single spaces, so line breaks and punctuation between words don't matter.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from turnout.llm.common import by_bytes, frugal

#: Phrases whose exact places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices sought with errors, with their labels. Words as in the texts, lower case.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "http www apache org licenses license 2 0": "apache",
    "gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause license": "bsd",
    "creative commons attribution": "cc",
    "licensed under cc by": "cc",
    "eclipse public license": "epl",
    "all rights reserved": "proprietary",
} | BASE

#: One error is allowed for so many letters.
LETTERS_PER_ERROR = 10

_WORD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def errors_of(notice: str) -> int:
    return len(notice) // LETTERS_PER_ERROR


def seeds(notice: str) -> list[tuple[int, str]]:
    """k + 1 parts of about equal length, with their places."""
    k = errors_of(notice)
    edges = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Scanner:
    def __init__(self, notices: dict[str, str] | None = None):
        import ahocorasick

        self.notices = NOTICES if notices is None else notices
        self.patterns = {n: regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n, literal_spaces=True)}){{e<={errors_of(n)}}}(?![^ ])".encode()) for n in self.notices}
        where: dict[str, list[tuple[str, int]]] = {}
        for n in self.notices:
            for at, seed in seeds(n):
                where.setdefault(seed, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for seed, owners in where.items():
            self.automaton.add_word(seed, (len(seed), owners))
        self.automaton.make_automaton()

    def fuzzy(self, norm: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, notice, errors) of every notice in normalised text, one per place and notice.

        A seed's own window, from word to word, holds any notice around it and is searched by
        itself, so a long run of hits costs a bounded search for each. Of matches of one
        notice that overlap the one with fewest errors stays, then the first.
        """
        windows: dict[str, set[tuple[int, int]]] = {}
        for end, (size, owners) in self.automaton.iter(norm.decode("latin-1")):
            for notice, at in owners:
                k = errors_of(notice)
                lo = end + 1 - size - at - k
                lo = norm.find(b" ", lo - 1) + 1 if lo > 0 else 0
                hi = end + 1 - size - at + len(notice) + k
                hi = norm.rfind(b" ", lo, hi + 1) if hi < len(norm) else len(norm)
                if hi - lo >= len(notice) - k:
                    windows.setdefault(notice, set()).add((lo, hi))
        out = []
        for notice, ws in windows.items():
            search = self.patterns[notice].search
            found = {(sum(m.fuzzy_counts), *m.span()) for m in (search(norm, lo, hi) for lo, hi in ws) if m is not None}
            taken: list[tuple[int, int]] = []
            for errors, a, b in sorted(found):
                i = bisect_right(taken, (a, b))
                if (not i or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                    taken.insert(i, (a, b))
                    out.append((a, b, notice, errors))
        return sorted(out)


def scan_text(scanner: Scanner, text: str) -> dict:
    """All results for one text; see `scan`."""
    words = text.encode().lower().translate(_WORD).split()
    norm = b" ".join(words)
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
    found = scanner.fuzzy(norm)
    padded = b" " + norm + b" "
    base: list[tuple[int, str]] = []
    for phrase, label in BASE.items():
        needle, at = b" " + phrase.encode() + b" ", -1
        while (at := padded.find(needle, at + 1)) >= 0:
            base.append((at, label))
    if not found and not base:
        return out
    begins = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    if base:
        places = [bisect_right(begins, at) - 1 for at, _ in base]
        out |= {"n_base": len(base), "first_word": min(places), "last_word": max(places)}
    exact = {label for _, label in base}
    out["base_labels"] = ",".join(sorted(exact))
    out["labels"] = ",".join(sorted(exact | {scanner.notices[n] for _, _, n, _ in found}))
    closest = max((1 - e / len(n) for _, _, n, e in found), default=0.0)
    out["score"] = 1.0 if base else closest
    out["spans"] = [
        {"label": scanner.notices[n], "notice": n, "first_word": bisect_right(begins, a) - 1, "last_word": bisect_right(begins, b - 1) - 1, "errors": e}
        for a, b, n, e in found
    ]
    return out


_COLUMNS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
    "labels": pa.string(), "score": pa.float64(),
    "spans": pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64())])),
}

def scan(docs: DataFrame) -> DataFrame:
    """One row per document with the licence notices in its whole text.

    A-Z are lowered; words are runs of bytes 0-9, a-z and 0x80-0xFF. n_base counts all places
    of the BASE phrases; first_word and last_word are their least and largest start, null
    without one. labels adds those of notices found with errors, whose spans are in `spans`
    (words, with the number of errors). score is 1 with an exact phrase, else one less the
    share of wrong letters of the closest notice, 0 without any. A null text counts as
    empty. One row for each input row; further columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in by_bytes(batches, "text"):
            rows = [scan_text(scanner, t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[c] for r in rows], kind) for c, kind in _COLUMNS.items())], ["doc_id", *_COLUMNS]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        frugal(run),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, notice: string, first_word: bigint, last_word: bigint, errors: bigint>>",
    )
