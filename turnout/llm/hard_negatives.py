"""Hard negatives by best-first search in packed R-trees of quantised vectors.

Rows are dealt by sort-tile-recursive packing: ranges of (label, first component) become slabs,
a slab in order of (label, second component) is cut into shards of SHARD rows, and a shard
is tiled again, label by label, along its three widest components into leaves of LEAF
neighbouring rows. A shard's tree is one row of packed arrays. Every node has a box, the
least and greatest value of each component below it, and an interval of labels. For an
anchor q each component of a box gives an interval of products, from q * lo to q * hi or the
other way round; their sums bound the score of all rows below from both sides.

A search takes nodes from a queue by their upper bound. A node is not opened if no label below
it can count, if its bounds lie outside every score window, or if its upper bound is
strictly below the k-th score found so far, after which the search is over, as all others
are no better. So what is left out cannot be in the result, ties included.

Anchors are packed into blocks of one label; a block meets chunks of SHARDS shards, which a
task takes one after the other with what it has found so far, so that bounds tighten and
only the few best of a chunk leave it. First the positives are found, in shards that hold
the block's label, then, in all others, the negatives of each window.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.llm.common import frugal, saved

SCALE = 256
K = 5
LOW, HIGH = 80, 100  # a negative's score in per cent of the positive's
SHARD, LEAF, FAN, BLOCK = 4096, 64, 16, 512
SHARDS = 16  # of a chunk
AXES = 3


def leaves(x: np.ndarray, rows: np.ndarray, axes: list[int]) -> list[np.ndarray]:
    """Sort-tile-recursive: rows in leaves of at most LEAF, sorted and cut along one axis after the other."""
    if len(rows) <= LEAF:
        return [rows] if len(rows) else []
    wanted = -(-len(rows) // LEAF)
    slabs = wanted if len(axes) < 2 else math.ceil(wanted ** (1 / len(axes)))
    if axes:
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
    size = -(-wanted // slabs) * LEAF
    parts = [rows[lo : lo + size] for lo in range(0, len(rows), size)]
    return parts if size == LEAF else [leaf for part in parts for leaf in leaves(x, part, axes[1:])]


def tiled(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, first row of each leaf with the end); leaves of a frequent label are its own."""
    spread = x.max(axis=0) - x.min(axis=0) if x.shape[1] else np.zeros(0)
    axes = np.argsort(-spread, kind="stable")[:AXES].tolist()
    kinds, n = np.unique(labels, return_counts=True)
    groups = [np.flatnonzero(labels == k) for k in kinds[n >= LEAF]]
    rest = np.flatnonzero(np.isin(labels, kinds[n < LEAF]))
    rest = rest[np.argsort(labels[rest], kind="stable")]
    found = [leaf for g in groups for leaf in leaves(x, g, axes)]
    found += [rest[lo : lo + LEAF] for lo in range(0, len(rest), LEAF)]
    return np.concatenate(found), np.cumsum([0, *map(len, found)])


class Tree:
    """A shard's rows in leaf order, and boxes and label intervals of its nodes, level by level from the leaves up."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, first: np.ndarray):
        self.ids, self.labels, self.x, self.first = ids, labels, x, first
        cut = first[:-1]
        level = (np.minimum.reduceat(x, cut, axis=0), np.maximum.reduceat(x, cut, axis=0), np.minimum.reduceat(labels, cut), np.maximum.reduceat(labels, cut))
        self.levels = [level]
        while len(level[2]) > 1:
            cut = np.arange(0, len(level[2]), FAN)
            level = tuple(f.reduceat(a, cut, axis=0) for f, a in zip((np.minimum, np.maximum, np.minimum, np.maximum), level, strict=True))
            self.levels.append(level)

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(least, greatest) possible score of each anchor with the rows below each node, for every level."""
        plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [(plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T) for lo, hi, _, _ in self.levels]

    def best_first(self, upper: list[np.ndarray], open_: list[np.ndarray]) -> Iterator[tuple[float, int]]:
        """(upper bound, leaf) by falling bound, through nodes that are open."""
        top = len(self.levels) - 1
        queue = [(-upper[top][j], top, j) for j in np.flatnonzero(open_[top]).tolist()]
        heapq.heapify(queue)
        while queue:
            bound, level, j = heapq.heappop(queue)
            if not level:
                yield -bound, j
                continue
            for c in range(FAN * j, min(FAN * j + FAN, len(open_[level - 1]))):
                if open_[level - 1][c]:
                    heapq.heappush(queue, (-upper[level - 1][c], level - 1, c))

    def nearest(self, anchor: np.ndarray, own: int, label: int, bounds: list, k: int, best: list[tuple[float, int]]) -> list[tuple[float, int]]:
        """(-score, id) of the k best rows with the anchor's label, but itself, here and in `best`."""
        open_ = [(low <= label) & (label <= high) for _, _, low, high in self.levels]
        for bound, leaf in self.best_first([upper for _, upper in bounds], open_):
            if len(best) == k and bound < -best[-1][0]:
                break
            a, b = self.first[leaf], self.first[leaf + 1]
            score = self.x[a:b] @ anchor
            pick = (self.labels[a:b] == label) & (self.ids[a:b] != own)
            if len(best) == k:
                pick &= score >= -best[-1][0]
            best = sorted([*best, *((-float(score[i]), int(self.ids[a + i])) for i in np.flatnonzero(pick))])[:k]
        return best

    def windows(self, anchor: np.ndarray, label: int, tops: list[int], bounds: list, k: int, found: list[list[tuple[int, int]]]) -> None:
        """Add to `found`, for each top score, (-score, id) of rows with another label from LOW to HIGH per cent of it; the k best stay."""
        # HIGH times a score may exceed 64 bits as a number, but not as Python's
        live = [j for j, t in enumerate(tops) if LOW * t <= HIGH * t]
        if not live:
            return
        floor = [LOW * t / HIGH - 1e-9 * abs(t) - 1e-9 for t in tops]
        ceiling = max(tops[j] for j in live)
        least = min(floor[j] for j in live)
        open_ = [~((low == label) & (high == label)) & (lower <= ceiling) & (upper >= least) for (_, _, low, high), (lower, upper) in zip(self.levels, bounds, strict=True)]
        for bound, leaf in self.best_first([upper for _, upper in bounds], open_):
            least = min(float(-found[j][-1][0]) if len(found[j]) == k else floor[j] for j in live)
            if bound < least:
                break
            a, b = self.first[leaf], self.first[leaf + 1]
            score = self.x[a:b] @ anchor
            for i in np.flatnonzero((score >= least) & (score <= ceiling) & (self.labels[a:b] != label)).tolist():
                s = whole(score[i])
                for j in live:
                    if LOW * tops[j] <= HIGH * s <= HIGH * tops[j]:
                        insort(found[j], (-s, int(self.ids[a + i])))
                        del found[j][k:]


def whole(score: float) -> int:
    """A score as a 64-bit number; those beyond it stop at its ends."""
    return int(max(-(2.0**63), min(2.0**63 - 1024, score)))


def _matrix(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1)
    return np.array([r["vec_id"] for r in rows], np.int64), x


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of SHARD consecutive rows of a partition, of vectors of one length."""
    slab, count, held = TaskContext.get().partitionId(), 0, []

    def packed() -> pa.RecordBatch:
        nonlocal count
        ids, x = _matrix(held)
        labels = np.array([r["label"] for r in held], np.int64)
        order, first = tiled(x, labels)
        blobs = [a.tobytes() for a in (ids[order], labels[order], x[order], first.astype(np.int64))]
        count += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([slab], pa.int32()), pa.array([slab << 32 | count], pa.int64()), pa.array([x.shape[1]], pa.int32()),
                pa.array([np.unique(labels).tolist()], pa.list_(pa.int64())), *(pa.array([y], pa.binary()) for y in blobs),
            ],
            ["slab", "shard", "d", "labels", "ids", "row_labels", "x", "first"],
        )

    for b in batches:
        for row in b.to_pylist():
            if held and (len(held) == SHARD or len(row["v"]) != len(held[0]["v"])):
                yield packed()
                held = []
            held.append(row)
    if held:
        yield packed()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a block as packed arrays; `tops` has the scores of their positives, `n_tops` how many each has."""
    for b in batches:
        for row in b.to_pylist():
            rows = row["rows"]
            ids, x = _matrix(rows)
            tops = [r["tops"] or [] for r in rows]
            flat = [p for t in tops for p in t]
            blobs = [
                ids.tobytes(), x.tobytes(), np.array([len(t) for t in tops], np.int64).tobytes(),
                np.array([p["positive_id"] for p in flat], np.int64).tobytes(), np.array([p["positive_score"] for p in flat], np.int64).tobytes(),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["d"]], pa.int32()), pa.array([row["label"]], pa.int64()), pa.array([row["g"]], pa.int32()), *(pa.array([y], pa.binary()) for y in blobs)],
                ["d", "label", "g", "anchors", "q", "n_tops", "top_ids", "tops"],
            )


_BLOCK = "d int, label long, g int, anchors binary, q binary, n_tops binary, top_ids binary, tops binary"
_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _search(negatives: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, found = None, None, []

        def out() -> pa.RecordBatch:
            rows = []
            for own, tops, best in zip(block.anchors.tolist(), block.tops, found, strict=True):
                if negatives:
                    rows += [(own, p, top, i, -s) for (p, top), each in zip(tops, best, strict=True) for s, i in each]
                else:
                    rows += [(own, None, None, i, whole(-s)) for s, i in best]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

        for b in batches:
            for r in b.to_pylist():
                key = (r["d"], r["label"], r["g"], r["chunk"])
                if held != key:
                    if held is not None:
                        yield out()
                    held, block = key, Block(r)
                    found = [[[] for _ in tops] if negatives else [] for tops in block.tops]
                ids = np.frombuffer(r["ids"], np.int64)
                tree = Tree(ids, np.frombuffer(r["row_labels"], np.int64), np.frombuffer(r["x"]).reshape(len(ids), r["d"]), np.frombuffer(r["first"], np.int64))
                each = tree.bounds(block.q)
                for a, own in enumerate(block.anchors.tolist()):
                    bounds = [(lower[a], upper[a]) for lower, upper in each]
                    if negatives:
                        tree.windows(block.q[a], r["label"], [top for _, top in block.tops[a]], bounds, k, found[a])
                    else:
                        found[a] = tree.nearest(block.q[a], own, r["label"], bounds, k, found[a])
        if held is not None:
            yield out()

    return run


class Block:
    """Anchors of a block with their vectors, and (id, score) of their positives."""

    def __init__(self, row: dict):
        number = lambda name: np.frombuffer(row[name], np.int64)
        self.anchors = number("anchors")
        self.q = np.frombuffer(row["q"]).reshape(len(self.anchors), row["d"])
        pairs = list(zip(number("top_ids").tolist(), number("tops").tolist(), strict=True))
        ends = np.cumsum(number("n_tops")).tolist()
        self.tops = [pairs[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v, d: one row for each vec_id that takes part, components as whole numbers."""
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = clean.where("vec_id is not null and label is not null and v is not null").where(~bad)
    least = clean.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    # the difference from a remainder keeps whole numbers beyond 64 bits, which floor() has not
    down = lambda x: scale * x - F.pmod(scale * x, F.lit(1.0))
    return least.select("vec_id", "label", F.transform("v", down).alias("v"), F.size("v").alias("d"))


def index(rows: DataFrame) -> DataFrame:
    """slab, shard, d, labels and the packed arrays of every shard's tree."""
    slabs = max(1, math.ceil(math.sqrt(rows.count() / SHARD)))
    keyed = rows.select("vec_id", "label", "v", "d", F.get("v", F.lit(0)).alias("c0"), F.get("v", F.lit(1)).alias("c1"))
    placed = keyed.repartitionByRange(slabs, "d", "label", "c0", "vec_id").sortWithinPartitions("d", "label", "c1", "vec_id")
    return placed.select("vec_id", "label", "v").mapInArrow(frugal(_shards), "slab int, shard long, d int, labels array<long>, ids binary, row_labels binary, x binary, first binary")


def _packed(anchors: DataFrame, groups: int) -> DataFrame:
    """Anchors in blocks of one vector length and label."""
    g = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(groups)).cast("int").alias("g")
    rows = anchors.groupBy("d", "label", g).agg(F.array_sort(F.collect_list(F.struct("vec_id", "v", "tops"))).alias("rows"))
    return rows.mapInArrow(frugal(_blocks), _BLOCK)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, k_positive: int = K, k: int = K) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(SCALE * x), x as double; a score is the inner product, exact up to
    2**53. Anchors are rows whose vec_id is divisible by `every`; the positives of one are
    its k_positive best other rows of the same label, ties to the smaller vec_id. For each
    the k best rows of other labels with a score from LOW to HIGH per cent of the
    positive's are returned; fewer if there are fewer, none for a negative score. Rows with
    a null vec_id, label or vector, or with null or non-finite components, take no part.
    Only vectors of equal length are compared. A vec_id that occurs several times counts
    once, with its least (label, vector). Further columns are ignored; an empty table gives
    an empty result.
    """
    rows = saved(quantised(vectors))
    shards = saved(index(rows))
    anchors = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-anchors.count() // BLOCK))
    none = F.lit(None).cast("array<struct<positive_id: bigint, positive_score: bigint>>")
    number = shards.count()
    chunk = F.pmod(F.xxhash64("shard"), F.lit(max(1, -(-number // SHARDS)))).cast("int").alias("chunk")
    places = saved(shards.select("slab", "shard", "d", "labels", chunk))

    def searched(blocks: DataFrame, pairs: DataFrame, negatives: bool, k: int) -> DataFrame:
        """Every block and chunk is one task's, shard after shard."""
        both = pairs.join(blocks, ["d", "label", "g"]).join(shards.drop("slab", "d", "labels"), "shard")
        order = ["d", "label", "g", "chunk"]
        return both.repartition(*order).sortWithinPartitions(*order, "shard").mapInArrow(frugal(_search(negatives, k)), _FOUND)

    blocks = saved(_packed(anchors.withColumn("tops", none), groups))
    keys = blocks.select("d", "label", "g")
    pairs = places.select("shard", "chunk", "d", F.explode("labels").alias("label")).join(keys, ["d", "label"])
    found = _first(searched(blocks, pairs, False, k_positive), ["anchor_id"], k_positive)
    positives = found.groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("tops")
    )
    asked = saved(_packed(anchors.join(positives.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), groups))
    last = places.agg(F.coalesce(F.max("slab"), F.lit(0))).scalar()
    everywhere = asked.select("d", "label", "g").withColumn("slab", F.explode(F.sequence(F.lit(0), last)))
    others = everywhere.join(places, ["slab", "d"]).where((F.size("labels") > 1) | (F.col("labels")[0] != F.col("label"))).select("shard", "chunk", "d", "label", "g")
    return _first(searched(asked, others, True, k), ["anchor_id", "positive_id"], k).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
