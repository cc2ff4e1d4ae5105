"""One penalised logistic fit for each fold, all folds at once, each without its own rows.

Newton's method for every fold side by side: an iteration is one job. Its gradient and curvature
are sums over all design cells, taken at the fold's weights, less those over the fold's own
cells. Cells meet folds in blocks, both of bounded size; a fold's partial sums are added
and its equations solved where they arrive. Weights are rows and never come to the driver,
which only learns whether some fold still moves.

The weights are an intercept, one for each design column and one for each artist, whose part
of the curvature is diagonal, so a fold costs the square of its columns, not of its artists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.session import compute_partitions, frozen

CELLS, FOLDS = 4096, 32  # of a block
STEP = 2.0  # no weight moves further in one iteration
ITERATIONS = 40
TOLERANCE = 1e-7  # slope for each row


def sums(x: np.ndarray, artist: np.ndarray, pos: np.ndarray, neg: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, gradient and curvature of the likelihood over some cells, one after the other."""
    k = x.shape[1]  # with the column of ones
    n_artists = len(w) - k
    n = pos + neg
    p = 1.0 / (1.0 + np.exp(-np.clip(x @ w[:k] + w[k + artist], -30.0, 30.0)))
    miss, curve = pos - n * p, n * p * (1 - p)
    weighted = curve[:, None] * x
    by_artist = lambda v: np.bincount(artist, v, n_artists)
    cross = [by_artist(weighted[:, j]) for j in range(k)]
    return np.concatenate([[n.sum()], x.T @ miss, by_artist(miss), (x.T @ weighted).ravel(), *cross, by_artist(curve)])


def step(total: np.ndarray, w: np.ndarray, k: int, l2: float, l2_artist: float) -> tuple[np.ndarray, float]:
    """(weights after one iteration, largest slope for each row before it)."""
    a = len(w) - k
    n, g, g_artist, curve, cross, own = np.split(total, np.cumsum([1, k, a, k * k, k * a]))
    pull = np.full(k, l2)
    pull[0] = 0.0
    g, g_artist = g - pull * w[:k], g_artist - l2_artist * w[k:]
    own = own + l2_artist
    cross = cross.reshape(k, a)
    curve = curve.reshape(k, k) + np.diag(pull + 1e-9)
    move = np.linalg.solve(curve - (cross / own) @ cross.T, g - cross @ (g_artist / own))
    move = np.concatenate([move, (g_artist - cross.T @ move) / own])
    slope = max(np.abs(g).max(), np.abs(g_artist).max(initial=0.0)) / max(n[0], 1.0)
    return w + np.clip(move, -STEP, STEP), float(slope)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of a block as packed arrays; all columns before `cells` are its key."""
    for b in batches:
        keys = b.schema.names[:-1]
        for i in range(b.num_rows):
            cells = b.column(len(keys)).slice(i, 1).flatten()
            column = lambda j: cells.field(j).to_numpy(zero_copy_only=False)  # noqa: B023
            x = np.column_stack([np.ones(len(cells)), *(column(j) for j in range(3, cells.type.num_fields))]).astype(np.float64)
            arrays = [x, column(0).astype(np.int64), column(1).astype(np.float64), column(2).astype(np.float64)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j).slice(i, 1) for j in range(len(keys))), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], [*keys, "x", "artist", "pos", "neg"]
            )


def _read(row: dict) -> tuple[np.ndarray, ...]:
    pos = np.frombuffer(row["pos"])
    return np.frombuffer(row["x"]).reshape(len(pos), -1), np.frombuffer(row["artist"], np.int64), pos, np.frombuffer(row["neg"])


def _partial(sign: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("folds")
            for i, row in enumerate(b.select([n for n in b.schema.names if n != "folds"]).to_pylist()):
                cells = _read(row)
                folds = b.column(at).slice(i, 1).flatten()
                out = []
                for fold_w in folds.field(1):
                    w = fold_w.values.to_numpy()
                    out.append((sign * sums(*cells, w)).tobytes())
                yield pa.RecordBatch.from_arrays([folds.field(0), folds.field(1), pa.array(out, pa.binary())], ["fold", "w", "part"])

    return run


def _solve(k: int, l2: float, l2_artist: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, key, w, total = None, None, None, None

        def out() -> pa.RecordBatch:
            new, slope = step(total, w, k, l2, l2_artist)
            return pa.RecordBatch.from_arrays([fold, pa.array([new], pa.list_(pa.float64())), pa.array([slope])], ["fold", "w", "slope"])

        for b in batches:
            for i in range(b.num_rows):
                part = np.frombuffer(b.column(2)[i].as_py())
                if total is not None and b.column(0)[i].as_py() == key:
                    total = total + part
                    continue
                if total is not None:
                    yield out()
                fold, key, w, total = b.column(0).slice(i, 1), b.column(0)[i].as_py(), b.column(1)[i].values.to_numpy(), part
        if total is not None:
            yield out()

    return run


def fit(cells: DataFrame, folds: DataFrame, columns: list[str], n_artists: int, l2: float, l2_artist: float) -> DataFrame:
    """(fold, w): for each row of `folds` (fold) the weights fitted on all cells of other folds.

    `cells` has fold, artist (0 to n_artists - 1), the design `columns`, pos and neg. w is the
    intercept, the columns' weights, then the artists'; an artist that only the fold itself
    has gets 0. A fold without cells is fitted on all of them.
    """
    spark, k = cells.sparkSession, 1 + len(columns)
    tasks = compute_partitions(spark)
    cell = F.struct("artist", "pos", "neg", *[F.col(c).cast("double").alias(c) for c in columns])
    packed = "x binary, artist binary, pos binary, neg binary"
    kind = dict(folds.dtypes)["fold"]
    merged = frozen(cells.groupBy("artist", *columns).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    n_blocks = max(1, -(-merged.count() // CELLS))
    spread = lambda n: F.pmod(F.xxhash64("artist", *columns), F.lit(n)).cast("int").alias("b")
    blocks = frozen(merged.groupBy(spread(n_blocks)).agg(F.collect_list(cell).alias("cells")).mapInArrow(_blobs, f"b int, {packed}"))
    own = frozen(cells.groupBy("fold", spread(n_blocks)).agg(F.collect_list(cell).alias("cells")).mapInArrow(_blobs, f"fold {kind}, b int, {packed}"))
    n_groups = max(1, -(-folds.count() // FOLDS))
    zeros = F.array_repeat(F.lit(0.0), k + n_artists)
    weights = frozen(folds.select("fold", zeros.alias("w")))
    for _ in range(ITERATIONS):
        group = F.pmod(F.xxhash64("fold"), F.lit(n_groups)).alias("g")
        groups = weights.groupBy(group).agg(F.collect_list(F.struct("fold", "w")).alias("folds"))
        pairs = groups.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "b").repartition(tasks, "g", "b")
        result = f"fold {kind}, w array<double>, part binary"
        plus = pairs.select("folds", "x", "artist", "pos", "neg").mapInArrow(_partial(1.0), result)
        mine = own.join(weights.select("fold", F.array(F.struct("fold", "w")).alias("folds")), "fold")
        minus = mine.select("folds", "x", "artist", "pos", "neg").mapInArrow(_partial(-1.0), result)
        placed = plus.unionByName(minus).repartition(tasks, "fold").sortWithinPartitions("fold")
        moved = frozen(placed.mapInArrow(_solve(k, l2, l2_artist), f"fold {kind}, w array<double>, slope double"))
        weights = moved.select("fold", "w")
        if moved.where(F.col("slope") > TOLERANCE).isEmpty():
            break
    return weights
