"""Byte-level BPE by a rank queue with a hierarchical bitmap, and decoding.

Pre-tokens are laid into one doubly linked list of ids with barriers between them. A
bucket per merge rank holds the list positions where that merge applies; a bitmap of
non-empty buckets with a summary word above it gives the least rank by find-first-set.
Entries that a neighbouring merge made stale are skipped when met. The cost is linear in
the number of merges, so one pre-token of a megabyte is no worse than many short ones.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from turnout.llm.common import buffers_of, by_bytes, frugal
from turnout.llm.units import Table, encoded, pre_units

BARRIER = 0xFFFF  # an id that no vocabulary of at most 65,535 tokens has
JOINED = 1 << 17  # bytes of new pre-tokens that share one queue


class Vocabulary:
    """Ranks of a vocabulary file: a line per token, base64 and rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        if max(ranks.values()) >= BARRIER:
            raise ValueError("the vocabulary is too large for 16-bit pairs")
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.pairs: dict[int, int] = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 16 | b] = r
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.first = np.full(1 << 16, -1, np.int64)
        for a in range(256):
            for b in range(256):
                r = ranks.get(bytes([a, b]))
                if r is not None:
                    self.first[a << 8 | b] = r

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of each pre-token."""
        out: list[bytes] = []
        lo = 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and (hi == lo or size + len(pieces[hi]) <= JOINED):
                size += len(pieces[hi])
                hi += 1
            out += self._merge(pieces[lo:hi])
            lo = hi
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.array([len(p) for p in pieces], np.int64)
        n = int(lengths.sum()) + len(pieces) + 1
        barriers = np.concatenate([[0], np.cumsum(lengths + 1)])
        start = np.full(n, BARRIER, np.int64)
        inside = np.ones(n, bool)
        inside[barriers] = False
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        start[inside] = self.byte[raw]
        rank = np.full(n, -1, np.int64)
        if len(raw) > 1:
            at = np.flatnonzero(inside)
            near = np.diff(at) == 1
            rank[at[:-1][near]] = self.first[raw[:-1][near] << 8 | raw[1:][near]]
        listed = np.ndarray.tolist if n < 1 << 18 else lambda a: array("q", a.tobytes())
        ids, due = listed(start), listed(rank)
        after, before = listed(np.arange(1, n + 1)), listed(np.arange(-1, n - 1))

        places = np.flatnonzero(rank >= 0)
        order = places[np.argsort(rank[places], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[order], prepend=-1))
        buckets: dict[int, list[int]] = {}
        leaf, top = [0] * ((len(self.tokens) >> 8) + 1), 0
        for r, b in zip(rank[order[cut]].tolist(), np.split(order, cut[1:]), strict=True) if len(order) else ():
            buckets[r] = b.tolist()
            leaf[r >> 8] |= 1 << (r & 255)
            top |= 1 << (r >> 8)

        pair = self.pairs.get
        while top:
            word = (top & -top).bit_length() - 1
            bits = leaf[word]
            low = bits & -bits
            r = word << 8 | (low.bit_length() - 1)
            leaf[word] = bits = bits ^ low
            if not bits:
                top ^= 1 << word
            bucket = buckets.pop(r)
            bucket.sort()
            for k, p in enumerate(bucket):
                if due[p] != r:
                    continue
                q = after[p]
                s, o = after[q], before[p]
                ids[p], ids[q], due[q] = r, -1, -1
                after[p], before[s] = s, p
                lower = False
                right = pair(r << 16 | ids[s], -1)
                left = pair(ids[o] << 16 | r, -1)
                due[p], due[o] = right, left
                for x, place in ((right, p), (left, o)):
                    if x >= 0:
                        b = buckets.get(x)
                        if b is None:
                            buckets[x] = [place]
                            leaf[x >> 8] |= 1 << (x & 255)
                            top |= 1 << (x >> 8)
                        else:
                            b.append(place)
                        lower = lower or x < r
                if lower:  # a lesser rank is due first; the rest of this bucket waits
                    rest = bucket[k + 1 :]
                    if rest:
                        buckets[r] = rest
                        leaf[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
                    break
        end = np.array(ids, np.int64)
        alive = (end >= 0) & inside
        total = np.concatenate([[0], np.cumsum(alive)])
        flat = end[alive].astype("<u4").tobytes()
        edges = (4 * total[barriers]).tolist()
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder:
    """Ids of whole texts: pre-tokens by `pattern`, each merged on its own; units seen before are looked up."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.table = Table()
        self.tokens = pa.array(vocabulary.tokens, pa.binary())

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.find(u.decode()) for u in units]
        some = list({p for ps in found for p in ps})
        ids = dict(zip(some, self.vocabulary.encode([p.encode() for p in some]), strict=True))
        each = [b"".join(map(ids.__getitem__, ps)) for ps in found]
        return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, place of each text's first one, with the end)."""
        data, cut, before = pre_units(col, lambda t: list(map(len, self.find(t))))
        ids, size = encoded(self.table, data, cut[:-1], cut[1:], self._learn)
        return ids, np.concatenate([[0], np.cumsum(size)])[before]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids one after another, place of each id's first one, with the end)."""
        return buffers_of(self.tokens.take(pa.array(ids)))


def _digests(enc: Encoder, ids: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Hashes of each text's ids and of the bytes decoded from them."""
    raw, off = enc.decode(ids)
    spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    flat = ids.astype("<u4")
    return [
        pa.array([hashlib.sha256(flat[x:y]).hexdigest() for x, y in spans], pa.string()),
        pa.array([hashlib.sha256(raw[off[x] : off[y]]).hexdigest() for x, y in spans], pa.string()),
    ]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of each text as little-endian unsigned 32-bit integers in `ids`, with round trip.

    Returns doc_id, n_tokens, ids (binary), ids_sha256, decoded_sha256. A null text counts
    as empty: no ids. No special tokens are known or added. One row for each input row,
    repeated ones too; further columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(Vocabulary(path), pattern)
        for b in by_bytes(batches, "text"):
            ids, at = enc.encode(b.column(1))
            each = pa.array([ids[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(at)), each, *_digests(enc, ids, at)],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        frugal(run), "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
    )


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As `encode`, without the ids, which then never leave the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(Vocabulary(path), pattern)
        for b in by_bytes(batches, "text"):
            ids, at = enc.encode(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(at)), *_digests(enc, ids, at)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
