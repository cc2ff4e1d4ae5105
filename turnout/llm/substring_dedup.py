"""Substring deduplication by relative Lempel-Ziv parsing against an index of reference blocks.

Every document is cut into blocks at places chosen by content: a block is a run of window
starts whose windows of `window` words share the same least hash of `ANCHOR` consecutive
words. Equal windows have equal anchors wherever they stand, so the index (block, first
document and place that has it) over all blocks of all documents serves as reference:

* a block that occurs whole in a document with a smaller doc_id is copied from there;
* where no whole block is found, but the anchor is shared with another document, a copy may
  begin or end inside the block. Only there single windows are looked up, against the
  windows of those blocks which are themselves first occurrences. A window in a copied
  block is in the first occurrence as well, so none is missed.

A document is then parsed from left to right: a factor begins at the first place with a
reference and goes on as long as the next block or window is copied from the place behind
it in the same document; where that ends, at the factor's boundary, the next one begins.
A factor (place, words, source document, place in it) covers a window at least, and all
words of factors are duplicate spans.

Anchors that no other document has (most) leave the plan after one aggregation, by a filter
of fixed size before they would be shuffled. All keys are 64- or 128-bit hashes; joins on
them are split by AQE where a passage is in very many documents, and no group is gathered
in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm import words as W
from turnout.llm.common import by_bytes, frugal, marked, saved

WINDOW = 50
ANCHOR = 16  # words of an anchor
U = W.U


def _window_hashes(col: pa.Array, window: int):
    """Valid window starts (in words of the batch), both window hashes and word numbering."""
    data, starts, ends, doc, n_words = W.spans(col)
    n = len(starts)
    base = np.concatenate([[0], np.cumsum(n_words)])
    if n < window:
        empty = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), empty, empty, empty, doc, base
    first = W.hashes(data, starts, ends, 1)
    levels: dict[int, np.ndarray] = {}
    one = W.grams(first, window, levels)
    anchor = W.sliding_min(W.grams(first, ANCHOR, levels), window - ANCHOR + 1)
    two = W.grams(W.hashes(data, starts, ends, 2), window)
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    return at, one[at], two[at], anchor[at], doc, base


def _blocks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            at, one, two, anchor, doc, base = _window_hashes(b.column(2), window)
            if not len(at):
                continue
            new = np.concatenate([[True], (np.diff(at) != 1) | (anchor[1:] != anchor[:-1])])
            cut = np.flatnonzero(new)
            size = np.diff(np.concatenate([cut, [len(at)]]))
            place = (np.arange(len(at)) - np.repeat(cut, size)).astype(np.uint64) * U(0x9E3779B97F4A7C15)
            rows = pa.array(doc[at[cut]])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(rows),
                    b.column(1).take(rows),
                    pa.array((at[cut] - base[doc[at[cut]]]).astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.array(anchor[cut].view(np.int64)),
                    pa.array(np.add.reduceat(W.mix(one + place), cut).view(np.int64)),
                    pa.array(np.add.reduceat(W.mix(two + place), cut).view(np.int64)),
                ],
                ["doc_id", "row_key", "lo", "n", "anchor", "b1", "b2"],
            )

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            at, one, two, _, doc, base = _window_hashes(b.column(2), window)
            marked = np.zeros(base[-1] + 1, bool)
            for i, ranges in enumerate(b.column(3).to_pylist()):
                for r in ranges:
                    marked[base[i] + r["lo"] : base[i] + r["lo"] + r["n"]] = True
            pick = np.flatnonzero(marked[at])
            rows = pa.array(doc[at[pick]])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(rows),
                    b.column(1).take(rows),
                    pa.array((at[pick] - base[doc[at[pick]]]).astype(np.int32)),
                    pa.array(one[pick].view(np.int64)),
                    pa.array(two[pick].view(np.int64)),
                ],
                ["doc_id", "row_key", "lo", "w1", "w2"],
            )

    return run


def factors(ranges: list[dict], window: int) -> list[list[int]]:
    """Parse of a document: [first word, words, source, first word there] from copied ranges of window starts."""
    out: list[list[int]] = []
    for r in sorted(ranges, key=lambda r: (r["lo"], -r["n"])):
        lo, n, source, there = r["lo"], r["n"], r["source"], r["there"]
        if out:
            first, words, last_source, last_there = out[-1]
            done = first + words - window + 1 - lo  # window starts of the range that the last factor has
            if done >= n:
                continue
            if done >= 0 and source == last_source and there - lo == last_there - first:
                out[-1][1] = lo + n + window - 1 - first
                continue
            if done > 0:
                lo, n, there = lo + done, n - done, there + done
        out.append([lo, n + window - 1, source, there])
    return out


def _keep(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            texts, found = b.column(2).to_pylist(), b.column(3).to_pylist()
            cols: list[list] = [[], [], [], [], [], []]
            for text, ranges in zip(texts, found, strict=True):
                ws = (text or "").encode().split()
                parsed = factors(ranges or [], window)
                merged: list[list[int]] = []
                for lo, n, _, _ in parsed:
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = lo + n
                    else:
                        merged.append([lo, lo + n])
                kept, last = [], 0
                for lo, hi in merged:
                    kept += ws[last:lo]
                    last = hi
                kept += ws[last:]
                cols[0].append(len(ws))
                cols[1].append(len(ws) - len(kept))
                out = b" ".join(kept)
                cols[2].append(hashlib.sha256(out).hexdigest())
                cols[3].append([{"first_word": lo, "n_words": hi - lo} for lo, hi in merged])
                cols[4].append([{"first_word": lo, "n_words": n, "source_id": i, "source_word": at} for lo, n, i, at in parsed])
                cols[5].append(out.decode() if merged else text)
            number = lambda name: (name, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.list_(pa.struct([number("first_word"), number("n_words")]))),
                 pa.array(cols[4], pa.list_(pa.struct([number("first_word"), number("n_words"), number("source_id"), number("source_word")]))),
                 pa.array(cols[5], pa.string()), *b.columns[4:]],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors", "kept_text", *b.schema.names[4:]],
            )

    return run


_KEPT = (
    "doc_id long, n_words long, n_removed long, kept_sha256 string, "
    "spans array<struct<first_word: bigint, n_words: bigint>>, "
    "factors array<struct<first_word: bigint, n_words: bigint, source_id: bigint, source_word: bigint>>, kept_text string"
)


def repeated_spans(docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """One row per document with what repeats an earlier one: the spans and what is left.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word is removed if a
    window of `window` consecutive words covers it whose words also start in a document
    with a smaller doc_id. Windows are judged on the input.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space),
    spans (first word and number of words), factors (the parse: first word, number of words,
    and the document and word they are copied from; neighbours may overlap), kept_text (the
    text unchanged where nothing is removed) and, with `carry`, those columns as a struct
    `carried`. Null and empty texts have no words and stay. A null doc_id
    neither removes nor is removed from. Rows with equal doc_id don't remove from each
    other, whether their texts are equal or not. Texts shorter than a window stay whole.
    Other columns are ignored. An empty table gives an empty result.
    """
    extra = [F.struct(*carry).alias("carried")] if carry else []
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text", *extra)
    known = src.where("doc_id is not null and text is not null").select("doc_id", "row_key", "text")
    blocks = saved(known.mapInArrow(frugal(_blocks(window)), "doc_id long, row_key long, lo int, n int, anchor long, b1 long, b2 long"))
    # what is aggregated is written before it is joined, so that AQE can split both sides of a hot key
    shared = saved(
        blocks.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most").select("anchor")
    )
    likely = marked(blocks, shared, ["anchor"]).where("maybe").drop("maybe")
    common = saved(likely.join(shared, "anchor").select("doc_id", "row_key", "lo", "n", "b1", "b2"))
    first = F.min(F.struct(F.col("doc_id").alias("source"), F.col("lo").alias("there"))).alias("f")
    index = saved(common.groupBy("b1", "b2").agg(first).select("b1", "b2", "f.*"))
    known_at = common.join(index, ["b1", "b2"])
    copied = F.col("source") < F.col("doc_id")
    judged = saved(known_at.select("doc_id", "row_key", "lo", "n", F.when(copied, F.col("source")).alias("source"), F.when(copied, F.col("there")).alias("there")))
    place = F.struct("lo", "n").alias("r")
    open_blocks = judged.where("source is null").groupBy("doc_id", "row_key").agg(F.collect_list(place).alias("ranges"))
    windows = saved(
        known.join(open_blocks.hint("shuffle_hash"), ["doc_id", "row_key"])
        .select("doc_id", "row_key", "text", "ranges")
        .mapInArrow(frugal(_windows(window)), "doc_id long, row_key long, lo int, w1 long, w2 long")
    )
    # half of a window's hash tells which may be in two documents; the places of those are found with all of it
    twice = saved(windows.groupBy("w1").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w1"))
    shared_windows = saved(windows.join(twice, "w1").select("doc_id", "row_key", "lo", "w1", "w2"))
    earliest = saved(shared_windows.groupBy("w1", "w2").agg(first, F.max("doc_id").alias("most")).where("f.source < most").select("w1", "w2", "f.*"))
    edges = (
        shared_windows.join(earliest, ["w1", "w2"]).where("source < doc_id")
        .select("doc_id", "row_key", "lo", F.lit(1).alias("n"), "source", "there")
    )
    found = (
        judged.where("source is not null").unionByName(saved(edges))
        .groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("lo", "n", "source", "there")).alias("ranges"))
    )
    return (
        src.join(found.hint("shuffle_hash"), ["doc_id", "row_key"], "left")
        .select("doc_id", "row_key", "text", "ranges", *(["carried"] if carry else []))
        .mapInArrow(frugal(_keep(window)), _KEPT + (f", carried {dict(src.dtypes)['carried']}" if carry else ""))
    )
