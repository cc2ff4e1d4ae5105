"""Periodic runs in the words of a text, by a suffix automaton whose link tree has link-cut access.

A run is a stretch of words with smallest period q, at least twice as long as q, that no
neighbouring word extends. The automaton of the words has a state for each prefix; the states
on the way from it to the root stand for the prefix's suffixes, the longest first. Taking the
prefixes in order, access paints that way in the colour of the prefix's end. What it paints
over falls into segments of one older colour each: suffixes of lengths in an interval that
ended last at the same place e. If the distance d = i - e from the new end lies in a
segment's interval, the suffix of length d has just come twice in a row: a square, and since
it did not end anywhere between, no shorter period is in it. At every place from the second
period of a run on its square is found, so consecutive places with one d are the run. Access
meets O(log n) segments for a word on average, whatever the text.

Runs of fewer than REPEATS periods or LEAST words are not reported. So before the automaton is
built a text is cut to stretches that may hold a reported run: in one, each three consecutive
words occur three times or more. Counting by hash keeps some too many, never too few; what is
left is counted again within its own stretch until nothing goes.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnout.llm import words as W
from turnout.llm.common import by_bytes, frugal

REPEATS, LEAST = 4, 6
LISTED = 1 << 18  # words of a stretch beyond which numbers are kept in arrays, not in lists
U = W.U


class Automaton:
    """Suffix automaton of a list of words: lengths and links of its states, and the state of each prefix.

    States are numbered from 1, the root. Most have one way on, which is kept in arrays;
    the others' ways are in `more`.
    """

    def __init__(self, words: list):
        n = 2 * len(words) + 2
        self.length, self.link, self.word, self.way = (_numbers(n, x) for x in (0, 0, -1, 0))
        self.more: dict[int, dict[int, int]] = {}
        self.size, self.last = 2, 1
        names: dict = {}
        self.prefixes = [self._append(names.setdefault(w, len(names))) for w in words]

    def _step(self, state: int, w: int) -> int:
        if self.word[state] == w:
            return self.way[state]
        ways = self.more.get(state)
        return ways.get(w, 0) if ways else 0

    def _set(self, state: int, w: int, to: int) -> None:
        known = self.word[state]
        if known in (w, -1):
            self.word[state], self.way[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _append(self, w: int) -> int:
        length, link = self.length, self.link
        new, self.size = self.size, self.size + 1
        length[new] = length[self.last] + 1
        at = self.last
        while at and not (to := self._step(at, w)):
            self._set(at, w, new)
            at = link[at]
        if not at:
            link[new] = 1
        elif length[at] + 1 == length[to]:
            link[new] = to
        else:
            copy, self.size = self.size, self.size + 1
            length[copy], link[copy] = length[at] + 1, link[to]
            self.word[copy], self.way[copy] = self.word[to], self.way[to]
            if to in self.more:
                self.more[copy] = dict(self.more[to])
            while at and self._step(at, w) == to:
                self._set(at, w, copy)
                at = link[at]
            link[to] = link[new] = copy
        self.last = new
        return new


def _numbers(n: int, fill: int):
    return [fill] * n if n < 2 * LISTED else array("q", [fill]) * n


class Paths:
    """Link-cut access on a rooted tree: each preferred path is a splay tree with one colour, kept at its root."""

    def __init__(self, parents):
        n = len(parents)
        self.up, self.left, self.right, self.colour = parents, _numbers(n, 0), _numbers(n, 0), _numbers(n, -1)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while (y := up[top]) and top in (left[y], right[y]):
            top = y
        if top == x:
            return
        self.colour[x] = self.colour[top]
        while (y := up[x]) and ((on_left := left[y] == x) or right[y] == x):
            z = up[y]
            if z and (y in (left[z], right[z])):
                if (left[z] == y) == on_left:
                    self._rotate(y)
                else:
                    self._rotate(x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        if left[y] == x:
            inner = right[x]
            left[y], right[x] = inner, y
        else:
            inner = left[x]
            right[y], left[x] = inner, y
        if inner:
            up[inner] = y
        up[y], up[x] = x, z

    def access(self, x: int, colour: int) -> list[tuple[int, int, int]]:
        """Paint the way from x to the root; (old colour, lowest node, node above its highest) of what had one colour."""
        met, below = [], 0
        while x:
            self._splay(x)
            rest = self.right[x]
            if rest:
                self.colour[rest] = self.colour[x]  # a path of its own from now on
            self.right[x] = below
            met.append((self.colour[x], x, self.up[x]))
            below, x = x, self.up[x]
        self.colour[below] = colour
        return met


def maximal_runs(words: list, repeats: int = 2, least: int = 1) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `repeats` periods and `least` words or more, by start, then period."""
    automaton = Automaton(words)
    length = automaton.length
    paths = Paths(automaton.link)
    open_runs: dict[int, list[int]] = {}
    out = []

    def close(period: int, first: int, last: int) -> None:
        if last - first + 1 >= max(least, repeats * period):
            out.append((first, last - first + 1, period))

    for i, state in enumerate(automaton.prefixes):
        for end, low, above in paths.access(state, i):
            d = i - end
            if end >= 0 and length[above] < d <= length[low]:
                run = open_runs.get(d)
                if run is not None and run[1] == i - 1:
                    run[1] = i
                    continue
                if run is not None:
                    close(d, *run)
                open_runs[d] = [i - 2 * d + 1, i]
    for d, run in open_runs.items():
        close(d, *run)
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(hashed: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges outside which no run of REPEATS periods and LEAST words lies, from word hashes and their documents."""
    if len(hashed) < LEAST:
        return []
    three = W.grams(hashed, 3)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    group = doc[at]
    slots = max(20, int(4 * len(at)).bit_length())
    key = (W.mix(three[at] + group.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(64 - slots)).astype(np.int64)
    often = np.bincount(key, minlength=1)[key] >= REPEATS - 1
    while True:
        before = len(at)
        at, group = at[often], group[often]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        long = np.bincount(group, minlength=1)[group] >= LEAST - 2
        at, group = at[long], group[long]
        if not len(at) or len(at) == before:
            break
        _, back, n = np.unique(W.mix(three[at] + group.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        often = n[back] >= REPEATS - 1
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return list(zip(at[first].tolist(), (at[last] + 3).tolist(), strict=True))


#: (doc_id, words) -> (first word, period) from where on the words repeat, or None
Plant = Callable[[int | None, int], tuple[int, int] | None]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """A tenth of all documents repeats a part of its words, as the query asks for."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    first = g % n
    return first, 1 + (n - first) // (3 + g % 8)


def found(b: pa.RecordBatch, plant: Plant | None) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """(words, reported runs) of each text of a batch (doc_id, text)."""
    col = b.column(1)
    data, starts, ends, doc, n_words = W.spans(col)
    base = np.concatenate([[0], np.cumsum(n_words)])
    source = np.arange(len(starts))
    moved: set[int] = set()
    if plant is not None:
        for k, (i, n) in enumerate(zip(b.column(0).to_pylist(), n_words.tolist(), strict=True)):
            where = plant(i, n)
            if where is not None:
                lo = base[k] + where[0]
                source[lo : base[k + 1]] = lo + np.arange(base[k + 1] - lo) % where[1]
                moved.add(k)
    hashed = W.hashes(data, starts, ends, 13)[source]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(col))]
    for lo, hi in stretches(hashed, doc):
        k = int(doc[lo])
        runs[k] += [(lo + s - int(base[k]), n, p) for s, n, p in maximal_runs(hashed[lo:hi].tolist(), REPEATS, LEAST)]
    for k, text in enumerate(col.to_pylist()):
        ws = (text or "").encode().split()
        if k in moved:
            ws = [ws[i] for i in (source[base[k] : base[k + 1]] - base[k]).tolist()]
        yield ws, sorted(runs[k], key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words, joined by one space, that no run contains after its first period."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, n, period in runs:
            gone[start + period : start + n] = True
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return b" ".join(words)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, plant: Plant | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), kept_text: one row for each document.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, numbered from 0, and equal
    if their 64-bit hashes are. Reported are runs of at least REPEATS periods and LEAST
    words; kept_text has the words that no reported run contains after its first period. A
    null or empty text has no words and no runs. With `plant`, words are repeated first; a
    null doc_id is never planted. Repeated rows are read alike; further columns are ignored;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            rows = [(len(ws), [{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed(ws, runs).decode()) for ws, runs in found(b, plant)]
            n, runs, text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(text, pa.string())], ["doc_id", "n_words", "runs", "kept_text"]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        frugal(run), "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept_text string"
    )


def digests(docs: DataFrame, plant: Plant | None = None) -> DataFrame:
    """What `periodic_runs` finds as digests, so that texts never leave the Python worker.

    Returns doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties:
    smallest start, then period; null without a run), runs_sha256 (a line `start,length,period`
    for each run) and collapsed_sha256 (of kept_text).
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            rows = []
            for ws, runs in found(b, plant):
                start, n, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                lines = "".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()
                rows.append((len(runs), start, n, period, None if n is None else 1000 * n // period, hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapsed(ws, runs)).hexdigest()))
            cols = zip(*rows, strict=True)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        frugal(run),
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string",
    )
