"""What the operators share: table access, tables written between stages, byte-bounded batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.session import ensure_checkpoint_dir

#: Bytes of text handled at once inside a task; one longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like checkpoint(), but keeps column pruning, and fixes rows
    whose numbering depends on how they lay in their partitions.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frugal(run: Callable) -> Callable:
    """`run` of mapInArrow, after which the worker holds little: Spark keeps it for other stages.

    Freed memory goes back to the system, so that what a stage needs does not add up with
    what earlier ones left in the same process.
    """

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim is not None:
                trim(0)

    return inner


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice record batches so that `column` (string) holds about `limit` bytes in each."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column))
        if not b.num_rows:
            continue
        offsets = buffers_of(col)[1]
        lo = 0
        while lo < b.num_rows:
            hi = lo + 1
            while hi < b.num_rows and offsets[hi + 1] - offsets[lo] <= limit:
                hi += 1
            yield b.slice(lo, hi - lo)
            lo = hi


def buffers_of(col: pa.Array):
    """Bytes and offsets of a string array as numpy views; a null text has length 0."""
    import numpy as np

    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bits of a key filter: 4 MB to broadcast, whatever the number of keys.
FILTER_BITS = 1 << 25
_BUCKET = 1 << 15  # bits of one bitmap of the built-in aggregate


def marked(df: DataFrame, keys: DataFrame, on: list[str], name: str = "maybe") -> DataFrame:
    """`df` with a flag that is false only where `on` is certainly not among `keys`.

    A bitmap of hashed keys of fixed size is broadcast, so that rows without a partner need
    no shuffle. With very many keys the flag is true more often; nothing is ever lost.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    bucket, bit = F.floor(place / _BUCKET), (place % _BUCKET).cast("long")
    maps = keys.select(bucket.alias("_b"), bit.alias("_p")).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_map"))
    byte = F.expr("cast(conv(hex(substring(_map, cast(_p div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.coalesce(F.expr("cast(_p % 8 as int)").isNotNull() & (F.call_function("getbit", byte, F.expr("cast(_p % 8 as int)")) == 1), F.lit(False))
    wide = df.withColumns({"_b": bucket, "_p": bit}).join(F.broadcast(maps), "_b", "left")
    return wide.withColumn(name, hit).drop("_b", "_p", "_map")


def without(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """`df` less the rows whose `on` is among `keys`; only possible partners are shuffled."""
    both = marked(df, keys, [on])
    sure, open_ = both.where("not maybe").select(df.columns), both.where("maybe").select(df.columns)
    return sure.unionByName(open_.join(keys.select(on).distinct(), on, "left_anti"))
