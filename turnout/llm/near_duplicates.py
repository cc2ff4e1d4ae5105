"""N-gram Jaccard join by MinHash banding, with exact verification on full shingle sets.

1. Every text becomes the set of its runs of five words (64-bit hashes). Texts with equal
   sets form a copy class, represented by its smallest doc_id; only representatives go on.
2. Each set gets `bands * rows` minima of seeded permutations. Two sets of Jaccard s share
   a band with probability 1 - (1 - s**rows)**bands; `plan_bands` takes the fewest bands
   that reach the target recall at the threshold.
3. Bands are shuffled on their hash. Buckets with the same members in several bands, the
   rule for near copies, are kept once.
4. A kept bucket is cut into chunks by a hash of the member, as many as its member and
   shingle counts ask for, and every pair of chunks is a tile. A tile has a bounded number
   of sets. All its pairs are compared in the task, as products of membership bits; a
   pair is counted in the first band it shares only. Pairs never become rows: a tile
   gives, for each member, its number of links and one edge into its linked group.
5. Edges give connected groups by repeated minimum over neighbours with pointer jumping.

No bucket is capped or sampled. A bucket of n sets costs n**2 bit operations, spread over
its tiles; exact link counts need that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm import words as W
from turnout.llm.common import by_bytes, frugal, marked, saved

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 6
TILE_SETS, TILE_SHINGLES = 512, 1 << 19  # of a chunk
U = W.U


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of `rows` minima that find a pair at the threshold with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first place of each text's in them, with the end)."""
    data, starts, ends, doc, n_words = W.spans(col)
    h = W.hashes(data, starts, ends, 3)
    base = np.concatenate([[0], np.cumsum(n_words)])
    at = np.flatnonzero(doc[: max(0, len(h) - SHINGLE + 1)] == doc[SHINGLE - 1 :])
    g, d = W.grams(h, SHINGLE)[at], doc[at]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):  # all words of a short text are its one shingle
        one = np.array([int(W.mix(np.cumsum(W.mix(h[base[i] : base[i + 1]] + np.arange(n_words[i], dtype=np.uint64)))[-1:] + U(n_words[i]))[0]) for i in short], np.uint64)
        g, d = np.concatenate([g, one]), np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[fresh], d[fresh]
    return g, np.searchsorted(d, np.arange(len(col) + 1))


def _signatures(bands: int, rows: int):
    steps = W.mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    factor, shift = steps[::2] | U(1), steps[1::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", 1 << 19):
            g, first = shingles(b.column(1))
            n = np.diff(first)
            full = np.flatnonzero(n > 0)
            if not len(full):
                continue
            cut = first[full]
            low = np.empty((bands * rows, len(full)), np.uint64)
            for k in range(bands * rows):
                low[k] = np.minimum.reduceat(W.mix_light(g, factor[k], shift[k]), cut)
            keys = np.empty((len(full), bands), np.uint64)
            for k in range(bands):
                key = np.full(len(full), U(k))
                for r in range(rows):
                    key = W.mix(key * U(0x2545F4914F6CDD1D) + low[k * rows + r])
                keys[:, k] = key
            flat = pa.array(keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(full)),
                    b.column(2).take(pa.array(full)),
                    pa.array(np.add.reduceat(W.mix(g + U(11)), cut).view(np.int64)),
                    pa.array(np.add.reduceat(W.mix(g + U(29)), cut).view(np.int64)),
                    pa.array(n[full].astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), flat),
                ],
                ["doc_id", "row_key", "s1", "s2", "n", "bands"],
            )

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tile of a representative, with its set."""
    for b in by_bytes(batches, "text", 1 << 19):
        g, first = shingles(b.column(1))
        tiles = b.column(4)
        size = np.diff(tiles.offsets.to_numpy())
        rows = pa.array(np.repeat(np.arange(b.num_rows), size))
        sets = pa.array([g[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
        tile = tiles.flatten()
        for lo in range(0, len(rows), 2048):
            r, t = rows[lo : lo + 2048], tile[lo : lo + 2048]
            yield pa.RecordBatch.from_arrays(
                [t.field("key"), t.field("side"), t.field("band"), t.field("pure"), b.column(0).take(r), b.column(2).take(r), b.column(3).take(r), sets.take(r)],
                ["key", "side", "band", "pure", "rep", "copies", "bands", "shingles"],
            )


def _tile(rows: list[dict], threshold: float) -> list[tuple[int, int, int]]:
    """(rep, linked documents, least rep it hangs on) for the members of one tile with a link."""
    n = len(rows)
    if n < 2:
        return []
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    if n == 2:
        common = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        both = np.array([[size[0], common], [common, size[1]]])
    else:
        # only shingles of several members matter
        every, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        ident = np.cumsum(new) - 1
        many = np.bincount(ident)[ident] > 1
        ident, owner = np.unique(ident[many], return_inverse=True)[1], owner[many]
        both = np.zeros((n, n))  # float64: a tie at the threshold must not be rounded below it
        last = int(ident.max(initial=-1)) + 1
        for lo in range(0, last, 4096):
            pick = (ident >= lo) & (ident < lo + 4096)
            part = np.zeros((n, min(4096, last - lo)), np.float32)
            part[owner[pick], ident[pick] - lo] = 1
            both += part @ part.T
    linked = both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-6
    band = rows[0]["band"]
    if not rows[0]["pure"]:  # a tile of two chunks: pairs inside a chunk belong to the chunk's own tile
        side = np.array([r["side"] for r in rows])
        linked &= side[:, None] != side[None, :]
    if band:
        keys = np.array([r["bands"][:band] for r in rows])
        for k in range(band):
            linked &= keys[:, k][:, None] != keys[:, k][None, :]
    np.fill_diagonal(linked, False)
    copies = np.array([r["copies"] for r in rows])
    links = linked @ copies
    reps = np.array([r["rep"] for r in rows])
    # least rep among a member and its neighbours, until nothing changes
    least = reps.copy()
    while True:
        best = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (best == least).all():
            break
        least = best
    return [(int(reps[i]), int(links[i]), int(least[i])) for i in np.flatnonzero(linked.any(axis=1))]


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a tile follow each other; only one tile is held at a time."""
        held: list[dict] = []
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "links", "least"])

        for b in batches:
            for row in b.to_pylist():
                if held and row["key"] != held[0]["key"]:
                    out += _tile(held, threshold)
                    held = []
                if not held or row["rep"] != held[-1]["rep"]:  # an input row that occurs twice comes twice
                    held.append(row)
            if len(out) > 4096:
                yield flush()
        if held:
            out += _tile(held, threshold)
        yield flush()

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(rep, least): the smallest id of the connected group of every id in edges (a, b).

    Every round takes the least label among neighbours and then the label of that label;
    rounds grow with the logarithm of a group's diameter. Rounds are written to the shared
    folder. Edges are spread by both ends; the minimum is combined before its shuffle.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("v"), "l"))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, labels["v"] == near["a"], "left").select("v", F.least("l", F.coalesce("m", "l")).alias("n"), "l")
        jump = labels.select(F.col("v").alias("u"), F.col("l").alias("far"))
        new = saved(step.join(jump, step["n"] == jump["u"], "left").select("v", F.least("n", F.coalesce("far", "n")).alias("l"), F.col("l").alias("old")))
        if new.where("l <> old").isEmpty():
            return labels.select(F.col("v").alias("rep"), F.col("l").alias("least"))
        labels = new.select("v", "l")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_links.

    Two documents are linked if the Jaccard index of their sets of five-word runs is at
    least `threshold`; words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. A
    text of one to four words has one shingle, all its words. copy_id is the smallest
    doc_id with the same set, class_id the smallest doc_id of the group connected by links.
    n_links counts the other documents linked to this one, copies included. Null texts,
    texts without a word and null ids have no links; their class_id is their own doc_id.
    Rows with equal doc_id are taken as one document by its larger text, and returned as
    often as they occur. Further columns are ignored; an empty table gives an empty result.
    """
    bands = plan_bands(threshold, recall, rows)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key"))
    known = src.where("doc_id is not null and text is not null")
    sig = saved(known.select("doc_id", "text", "row_key").mapInArrow(frugal(_signatures(bands, rows)), "doc_id long, row_key long, s1 long, s2 long, n long, bands array<long>"))
    own = sig.groupBy("doc_id").agg(F.max(F.struct("n", "s1", "s2", "row_key")).alias("x")).select("doc_id", "x.*")
    # written before the join, so that AQE can split the side of a set that very many documents have
    classes = saved(own.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    member = saved(own.join(classes, ["s1", "s2", "n"]).select("doc_id", "rep", "copies", "row_key"))
    reps = member.where("doc_id = rep").select("doc_id", "row_key", "copies")
    chosen = sig.join(reps, ["doc_id", "row_key"]).select(F.col("doc_id").alias("rep"), "row_key", "copies", "n", "bands")
    banded = saved(chosen.select("rep", "n", F.posexplode("bands").alias("band", "key")))
    buckets = (
        banded.groupBy("band", "key")
        .agg(
            F.count("*").alias("m"), F.sum("n").alias("total"), F.min("rep").alias("least"),
            F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("who"),
        )
        .where("m > 1")
    )
    kept = buckets.groupBy("m", "total", "who", "least").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "m", "total")
    chunks = F.ceil(F.greatest(F.col("m") / TILE_SETS, F.col("total") / TILE_SHINGLES)).cast("int").alias("chunks")
    tiles = banded.join(kept.select("band", "key", chunks), ["band", "key"]).select(
        "rep", "band", "key", "chunks", F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("chunks")).cast("int").alias("c")
    )
    places = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda o: F.struct(
            F.xxhash64("band", "key", F.least("c", o), F.greatest("c", o)).alias("key"), F.col("c").alias("side"), "band", (o == F.col("c")).alias("pure")
        ),
    )
    wanted = tiles.groupBy("rep").agg(F.flatten(F.collect_set(places)).alias("tiles"))
    needed = saved(chosen.join(wanted, "rep").select("rep", "row_key", "copies", "bands", "tiles"))
    likely = marked(known.withColumnRenamed("doc_id", "rep"), needed, ["rep", "row_key"]).where("maybe").drop("maybe")
    facts = (
        likely.join(needed.hint("shuffle_hash"), ["rep", "row_key"])
        .select("rep", "text", "copies", "bands", "tiles")
        .mapInArrow(frugal(_members), "key long, side int, band int, pure boolean, rep long, copies long, bands array<long>, shingles binary")
        .repartition("key")
        .sortWithinPartitions("key", "rep")
        .mapInArrow(frugal(_compare(threshold)), "rep long, links long, least long")
    )
    found = saved(facts)
    groups = connected(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    result = (
        member.join(groups, "rep", "left").join(links, "rep", "left")
        .select(
            "doc_id",
            F.coalesce("least", "rep").alias("class_id"),
            F.col("rep").alias("copy_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return (
        src.select("doc_id").join(result, "doc_id", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
