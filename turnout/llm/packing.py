"""Packing of tokenised documents into sequences: shortest-pack-first over the length histogram.

A document's ids are cut into pieces of a whole sequence, then one piece of a multiple of
`grid`, then what is left; this depends on the document alone. Only the histogram of
piece lengths, at most `capacity` numbers, comes to the driver. There lengths are placed
longest first, each into the open packs with most room; a pack pattern carries the number
of packs that look like it, so the work depends on the distinct lengths, not on the
documents. Pieces then find their pack by rank among pieces of their length.

Ranks come without gathering a length in one task: a piece is numbered among those of its
length in its own partition when the pieces are written, and the counts of the partitions
before are added.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnout.llm import words as W
from turnout.llm.common import buffers_of, by_bytes, frugal, saved
from turnout.llm.units import ALNUM, MARK, Table, encoded

CAPACITY = 2048
GRID = 512  # the last piece of a document but one is a multiple of this long
END = 1  # id after each document


class WordIds:
    """Ids of whole texts by a lower-casing word-level BPE file whose words never cross white space.

    Words are looked up after lowering A-Z, which the file's own normalisation does as well,
    and without a last mark of punctuation, which is a word of its own to the tokenizer; the
    library encodes each new word once. Texts that hold the opening of a special token are
    neither lowered nor cut first, as the library matches those before it lowers.
    """

    def __init__(self, path: str):
        os.environ["RAYON_NUM_THREADS"] = "1"  # Spark runs a task on every core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # words of letters are split by blanks alone, which spares the file's pattern
        self.by_pattern = self.tokenizer.pre_tokenizer
        self.by_blank = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.table = Table()

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words go to the library many at a time; each ends with a token that ends a word."""
        found: list[bytes] = [b""] * len(words)
        texts = [w.decode() for w in words]
        # letters up to U+024F that are small already have no other form
        plain = [i for i, t in enumerate(texts) if t.isalpha() and t == t.lower() and max(t) < "\u0250"]
        odd = sorted(set(range(len(words))) - set(plain))
        groups = [plain[lo : lo + 256] for lo in range(0, len(plain), 256)]
        self.tokenizer.pre_tokenizer = self.by_blank
        for lo in range(0, len(groups), 16):
            some = groups[lo : lo + 16]
            got = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in some], add_special_tokens=False)
            for group, e in zip(some, got, strict=True):
                ids = np.array(e.ids, "<u4")
                edges = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
                if len(edges) != len(group) + 1 or edges[-1] != 4 * len(ids):
                    odd += group
                    continue
                flat = ids.tobytes()
                for i, x, y in zip(group, edges[:-1], edges[1:], strict=True):
                    found[i] = flat[x:y]
        self.tokenizer.pre_tokenizer = self.by_pattern
        for lo in range(0, len(odd), 4096):
            some = odd[lo : lo + 4096]
            got = self.tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)
            for i, e in zip(some, got, strict=True):
                found[i] = np.array(e.ids, "<u4").tobytes()
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)

    def encode(self, col: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each followed by `end`, place of each text's first one, with the end)."""
        data, starts, ends, doc, n_words = W.spans(col)
        special = pc.fill_null(pc.match_substring(col, "<|"), False).to_numpy(zero_copy_only=False)
        small = _LOWER[data]
        offsets = buffers_of(col)[1]
        for i in np.flatnonzero(special):
            small[offsets[i] : offsets[i + 1]] = data[offsets[i] : offsets[i + 1]]
        marked = np.flatnonzero((ends - starts > 1) & MARK[data[ends - 1]] & ALNUM[data[ends - 2]] & ~special[doc]) if len(starts) else np.zeros(0, np.int64)
        starts = np.insert(starts, marked + 1, ends[marked] - 1)
        stem = ends.copy()
        stem[marked] -= 1
        ends = np.insert(stem, marked + 1, ends[marked])
        before = np.concatenate([[0], np.cumsum(n_words + np.bincount(doc[marked], minlength=len(col)))])
        ids, size = encoded(self.table, small, starts, ends, self._learn)
        first = np.concatenate([[0], np.cumsum(size)])[before]
        return np.insert(ids, first[1:], end), first + np.arange(len(first))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def cuts(n: int, capacity: int, grid: int) -> list[int]:
    """Piece lengths of a document of n ids."""
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    body = rest - rest % grid
    return out + [x for x in (body, rest - body) if x]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, grid: int = GRID, end: int = END) -> DataFrame:
    """Pieces of every document, with their number among pieces of their length in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordIds(path)
        seen = [0] * (capacity + 1)
        part = TaskContext.get().partitionId()
        for b in by_bytes(batches, "text"):
            cols: list[list] = [[], [], [], [], [], []]
            rows = []
            ids, first = enc.encode(b.column(1), end)
            for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                at = 0
                for n in cuts(hi - lo, capacity, grid):
                    rows.append(i)
                    crc = zlib.crc32(ids[lo + at : lo + at + n])
                    for col, x in zip(cols, (at, n, crc, hi - lo, part, seen[n]), strict=True):
                        col.append(x)
                    seen[n] += 1
                    at += n
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(run), _PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of packs, piece lengths in them) that hold every length as often as it occurs."""
    room: dict[int, list[list]] = {}  # free places -> [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: dict[int, list[list]] = {}
        while left:
            free = max((f for f in room if f >= length), default=None)
            if free is None:
                # as many packs as it takes to hold all that are left of this length
                each = capacity // length
                full, more = divmod(left, each)
                for count, k in ((full, each), (1 if more else 0, more)):
                    if count:
                        placed.setdefault(capacity - k * length, []).append([count, (length,) * k])
                left = 0
                break
            packs = room[free]
            count, lengths = packs[-1]
            each = free // length
            full = min(count, left // each)
            if full:
                placed.setdefault(free - each * length, []).append([full, lengths + (length,) * each])
                left -= full * each
                used = full
            else:
                placed.setdefault(free - left * length, []).append([1, lengths + (length,) * left])
                left, used = 0, 1
            if used == count:
                packs.pop()
                if not packs:
                    del room[free]
            else:
                packs[-1][0] = count - used
        for free, packs in placed.items():
            room.setdefault(free, []).extend(packs)
    return [(count, lengths) for packs in room.values() for count, lengths in packs]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) in order: where ranks of a length go."""
    rows, taken, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            rows.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + count
            offset += n
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, grid: int = GRID, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, and the end id after it, is in exactly one piece; pieces of
    a sequence follow each other without a gap from offset 0. A null or empty text is the
    end id alone. Rows with equal doc_id are documents of their own. Further columns are
    ignored; an empty table gives an empty result.
    """
    rows = saved(pieces(docs, path, capacity, grid, end))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    where = places(shortest_pack_first(histogram, capacity))
    keys = (where[:, 0] << 44) + where[:, 1]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (2, 5))
            i = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence = where[i, 2] + rank - where[i, 1] if len(i) else np.zeros(0, np.int64)
            offset = where[i, 3] if len(i) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return (
        rows.join(offsets, ["length", "part"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("rank"))
        .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
