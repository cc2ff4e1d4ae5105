"""Units of text that are encoded on their own, and a table of those seen before.

A unit is a run of bytes, given by its start and end in a batch's buffer. Units are known by
a 64-bit hash of their bytes, so that no Python object is made for one that was seen before:
a task that meets a million different units confuses two of them with a chance of 3e-8. The
table is bounded in units and ids, and empties itself beyond that.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from turnout.llm import words as W
from turnout.llm.common import buffers_of

#: Units and ids that a table holds; about 30 bytes a unit.
ROOM, IDS = 1 << 20, 1 << 22
#: Units handled at once.
SLICE = 1 << 18

MARK = np.zeros(256, bool)
MARK[list(b".,;:!?")] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Table:
    """Ids of units by hash; `learn(places)` gives (all ids, how many each) of units it does not know."""

    def __init__(self, room: int = ROOM, ids: int = IDS):
        self.room, self.limit = room, ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 12, np.uint32), 0

    def rows(self, hashed: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Row of every unit in the table, which holds all of them afterwards."""
        some, at, back = np.unique(hashed, return_index=True, return_inverse=True)
        place, known = self._find(some)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) + len(new) > self.room or self.used > self.limit:
                self.clear()
                new, place = np.arange(len(some)), np.zeros(len(some), np.int64)
            flat, size = learn(at[new])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            first = self.used + np.cumsum(size) - size
            self.used += len(flat)
            self.keys = np.insert(self.keys, place[new], some[new])
            self.first = np.insert(self.first, place[new], first)
            self.size = np.insert(self.size, place[new], size)
            place = np.searchsorted(self.keys, some)
        return place[back]

    def _find(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.keys, some)
        if not len(self.keys):
            return place, np.zeros(len(some), bool)
        return place, self.keys[np.minimum(place, len(self.keys) - 1)] == some

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows one after another, how many each has)."""
        size = self.size[rows]
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(0, np.uint32), size
        return self.ids[np.repeat(self.first[rows] - ends + size, size) + np.arange(ends[-1])], size


def texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes() if len(data) < 1 << 22 else memoryview(data)
    return [bytes(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


# bytes that end a plain text's claim, or begin a character that may be a blank
_CONTROL = np.zeros(256, bool)
_CONTROL[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_OTHER_BLANK = re.compile("[^\\S \n]|[\u180e\u200b\ufeff]")


def pre_units(col: pa.Array, odd_lengths: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, unit starts with the end, units before each text with the end) for byte-level vocabularies.

    Their splitting pattern starts a new match at every single space between two other
    characters, and makes a single line feed between two such characters a match of its own.
    A text whose only blanks are of these two kinds is cut there, and before a last mark of
    punctuation after an ASCII letter or digit. For any other text `odd_lengths` gives the
    lengths, in characters, of its parts.
    """
    data, offsets = buffers_of(col)
    n = len(data)
    space, feed = data == 0x20, data == 0x0A
    blank = space | feed
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    # a text is odd by a control character, by two blanks side by side or a blank at an end
    bad = _CONTROL[data] | (blank & (edge[:n] | edge[1:] | np.concatenate([[False], blank[:-1]])[:n]))
    of = lambda flags: np.searchsorted(offsets, np.flatnonzero(flags), side="right") - 1
    odd = set(of(bad).tolist())
    odd |= {i for i in set(of(_LEAD[data]).tolist()) - odd if _OTHER_BLANK.search(col[i].as_py())}
    cut = edge[:n] | blank
    cut[1:] |= feed[:-1]
    ends = np.concatenate([blank[1:], [True]])[:n] | edge[1:]  # what stands before a blank or the end of its text
    last = np.flatnonzero(ends & MARK[data] & ~edge[:n])
    cut[last[ALNUM[data[last - 1]]]] = True
    for i in odd:
        lo, hi = offsets[i], offsets[i + 1]
        text = col[i].as_py()
        lengths = odd_lengths(text)
        if len(text) != hi - lo:
            at, sizes = 0, []
            for k in lengths:
                sizes.append(len(text[at : at + k].encode()))
                at += k
            lengths = sizes
        cut[lo:hi] = False
        cut[lo + np.cumsum([0, *lengths[:-1]])] = True
    starts = np.flatnonzero(cut)
    return data, np.concatenate([starts, [n]]), np.searchsorted(starts, offsets)


def encoded(table: Table, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units, how many each has); `learn` gets the bytes of new units."""
    flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for lo in range(0, len(starts), SLICE):
        s, e = starts[lo : lo + SLICE], ends[lo : lo + SLICE]
        rows = table.rows(W.hashes(data, s, e, 5), lambda at, s=s, e=e: learn(texts(data, s[at], e[at])))
        ids, size = table.gather(rows)
        flat.append(ids)
        sizes.append(size)
    return np.concatenate(flat), np.concatenate(sizes)
