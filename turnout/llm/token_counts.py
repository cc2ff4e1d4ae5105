"""Token counts by the library of a tokenizer file, without its ids leaving the task.

Batches are cut by bytes, not by rows; a long text is cut at places where its tokens
don't change (see `units`) and its parts are counted apart. In ordinary prose these
places are so dense that most parts are words seen before, whose counts are kept; the
library encodes only new ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from turnout.llm.common import by_bytes, frugal
from turnout.llm.units import Table, encoded, pre_units

PART = 1 << 16  # characters of a part of a text with unusual blanks
_SAFE = re.compile(r"(?<=[^\s\u180e\u200b\ufeff]) (?=[^\s\u180e\u200b\ufeff])")


def parts(text: str, limit: int = PART) -> list[int]:
    """Lengths of parts of about `limit` characters, cut before single spaces; a part without one stays whole."""
    out, lo = [], 0
    while len(text) - lo > limit:
        m = _SAFE.search(text, lo + limit)
        if m is None:
            break
        out.append(m.start() - lo)
        lo = m.start()
    return [*out, len(text) - lo]


class Counter:
    """Counts tokens of texts with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["RAYON_NUM_THREADS"] = "1"  # Spark runs a task on every core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.table = Table()

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One number for each unit, its count."""
        out: list[int] = []
        lo = 0
        while lo < len(units):
            hi, size = lo, 0
            while hi < len(units) and hi - lo < 4096 and (hi == lo or size < PART * 4):
                size += len(units[hi])
                hi += 1
            out += map(len, self.tokenizer.encode_batch_fast([u.decode() for u in units[lo:hi]], add_special_tokens=False))
            lo = hi
        return np.array(out, np.uint32), np.ones(len(out), np.int64)

    def count(self, col: pa.Array) -> np.ndarray:
        data, cut, before = pre_units(col, parts)
        n, _ = encoded(self.table, data, cut[:-1], cut[1:], self._learn)
        return np.diff(np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[before])


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit`) for every text.

    A null text counts as empty: 0 bytes, 0 tokens. No begin, end or added special tokens;
    strings of special tokens inside a text are what the library makes of them. One row
    for each input row; further columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in by_bytes(batches, "text"):
            text = b.column(1).fill_null("")
            n = pa.array(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        frugal(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
