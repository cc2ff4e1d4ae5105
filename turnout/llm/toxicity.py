"""Toxicity by maximum-scoring segments over token log-odds, with extreme-value calibration.

Training counts in how many toxic and other labelled documents a token occurs. A token is
a lower-cased word; its prefixes are counted as well. A word that a text repeats counts
once in training; in a text's score each of its places counts. Log-odds have informative Dirichlet priors: a
prefix is drawn towards the odds of the next shorter one, a word towards those of its
longest prefix, the shortest towards all text. So an unseen form of an abusive stem is
scored by the stem, and a rare word by little more than the prior. All tokens of LEAST
documents or more are in the model, which the sample bounds.

Scoring walks over a text once. The scores of its words, less a drift that makes ordinary
text lose, are split into all maximal-scoring segments in linear time. The best segments
are compared with what chance gives in text of that length: maxima of such sums follow an
extreme-value law with decay `decay` (the positive root of E[exp(decay * s)] = 1 over
distinct words of non-toxic texts), so a segment of sum S in n words has the normalised height
decay * S - log(n), and segments above `SIGNIFICANT` are reported. Heights become scores
between 0 and 1 by an isotonic curve. It is fitted on a third of the training documents,
with a model counted on the others, so that it knows how unseen texts score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm import words as W
from turnout.llm.common import buffers_of, by_bytes, frugal, saved

#: Labelled documents that the model is counted on, at most.
SAMPLE = 40_000
#: Scores of words that a task keeps, and the letters of one that is kept.
CACHED, LETTERS = 200_000, 40
PREFIXES = (4, 5, 7)
PRIOR = 4.0  # pseudo-counts of a token's parent
LEAST = 3  # documents that a token must occur in
DRIFT = 1.0  # taken from every word's score
SIGNIFICANT = 3.0  # height of a reported passage: chance gives about exp(-3) per text
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def _hashed(tokens: pa.Array, seed: int) -> np.ndarray:
    data, offsets = buffers_of(tokens)
    return W.hashes(data, offsets[:-1], offsets[1:], seed)


@dataclass(eq=False)
class Model:
    """Scores of words and of prefixes by rising 64-bit hashes, and the calibration."""

    words: tuple[np.ndarray, np.ndarray]
    stems: tuple[np.ndarray, np.ndarray]
    rest: float
    decay: float
    knots: tuple[tuple[float, ...], tuple[float, ...]]  # heights and their scores, both rising

    @staticmethod
    def of(scores: dict[str, float], rest: float, decay: float, knots=((), ())) -> Model:
        """From scores by token; a prefix is marked by a leading *."""
        parts = []
        for seed, mark in ((21, False), (22, True)):
            some = {t[mark:]: s for t, s in scores.items() if (t[:1] == "*") == mark}
            keys = _hashed(pa.array(list(some), pa.string()), seed)
            order = np.argsort(keys)
            parts.append((keys[order], np.array(list(some.values()), np.float64)[order]))
        return Model(*parts, rest, decay, knots)

    def scores(self, words: list[str]) -> dict[str, float]:
        """Of each word its own score, else that of its longest known prefix, else that of any word."""
        if not words:
            return {}
        tokens = pa.array(words, pa.string())
        length = pc.utf8_length(tokens).to_numpy()
        out = np.full(len(words), self.rest)
        open_ = self._look(self.words, _hashed(tokens, 21), out, np.arange(len(words)))
        for n in reversed(PREFIXES):
            some = open_[length[open_] > n]
            if len(some):
                stems = pc.utf8_slice_codeunits(tokens.take(pa.array(some)), 0, n)
                left = self._look(self.stems, _hashed(stems, 22), out, some)
                open_ = np.concatenate([open_[length[open_] <= n], left])
        return dict(zip(words, out.tolist(), strict=True))

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], hashed: np.ndarray, out: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Write known scores to their places; the places that are not known."""
        keys, values = table
        if not len(keys):
            return at
        i = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        hit = keys[i] == hashed
        out[at[hit]] = values[i[hit]]
        return at[~hit]

    def score(self, word: str) -> float:
        return self.scores([word])[word]

    def probability(self, height: float) -> float:
        """Between 0 and 1, strictly rising with height so that equal knots don't tie."""
        p = float(np.interp(height, *self.knots)) if self.knots[0] else 0.0
        return min(1.0, 0.999 * p + 0.001 / (1 + math.exp(-max(-30.0, min(30.0, height / 20)))))


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (sum, first, behind the last), left to right, in linear time.

    Each candidate keeps the running total before and after it; a new one is joined with
    the nearest earlier candidate that starts lower and ends lower, again and again.
    """
    total, stack = 0.0, []  # (before, after, first, end, place of the nearest candidate with a lower start)
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, after = i, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= after:
                stack.append((before, after, first, i + 1, j))
                break
            before, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(after - before, first, end) for before, after, first, end, _ in stack]


class Scored:
    """Words of texts with their scores, less the drift; short words' scores are kept between texts."""

    def __init__(self, model: Model):
        self.model, self.kept = model, {}

    def steps(self, texts: Iterable[str]) -> Iterator[tuple[list[str], list[float]]]:
        """(words, steps) of each text; those that are not kept are looked up together."""
        if len(self.kept) > CACHED:
            self.kept = {}
        found = [_WORD.findall(t.lower()) for t in texts]
        new = self.model.scores(list({w for ws in found for w in ws if w not in self.kept}))
        new = {w: s - DRIFT for w, s in new.items()}
        self.kept.update(new)
        for ws in found:
            yield ws, [self.kept[w] for w in ws]
        for w in new:
            if len(w) > LETTERS:
                del self.kept[w]


def heights(model: Model, words: list[str], steps: list[float]) -> tuple[float, int, list[tuple[float, int, int]]]:
    """(normalised height of a text, words, significant segments) from its words and their steps."""
    n = len(words)
    log_n = math.log(n + 1)
    tops, sums = [], []
    for s, a, b in segments(steps):
        tops.append((model.decay * s - log_n, a, b))
        # for the text's height, words that a passage repeats count once in it
        once = {w: x for w, x in zip(words[a:b], steps[a:b], strict=True) if x > 0}
        sums.append(model.decay * (sum(once.values()) + sum(x for x in steps[a:b] if x <= 0)) - log_n)
    if not tops:
        return -log_n, n, []
    # the heights of several passages add up as exponentials of their excess over chance
    best = max(sums)
    height = best + math.log(sum(math.exp(max(-30.0, h - best)) for h in sums))
    return height, n, [t for t in tops if t[0] >= SIGNIFICANT]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is never learned; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, apart) of labelled documents outside the held-out fold, at most about `sample`.

    The sample is drawn by a hash of doc_id, by a share computed from the number of labels,
    so it doesn't depend on partitions. Null labels and ids are left out; a document with
    several labels counts as toxic if one of them says so.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n = marks.count()
    if n > sample:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    # the sample's bound makes it fit for a broadcast, so that texts are not shuffled
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id").select("text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("apart"))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word and prefix, by label and by whether they are set apart, summed within a task."""
    names = ["other", "toxic", "other_apart", "toxic_apart"]
    sums: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        cols = list(zip(*sums.values(), strict=True)) or [()] * 4
        out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["token", *names])
        sums.clear()
        return out

    for b in by_bytes(batches, "text"):
        for text, toxic, apart in zip(*(c.to_pylist() for c in b.columns), strict=True):
            tokens = set(_WORD.findall((text or "").lower()))
            for n in PREFIXES:
                tokens |= {"*" + w[:n] for w in tokens if len(w) > n and w[0] != "*"}
            for w in tokens:
                sums.setdefault(w, [0, 0, 0, 0])[2 * apart + (toxic > 0)] += 1
        if len(sums) > 250_000:
            yield flush()
    yield flush()


class Tokens:
    """Counted tokens as arrays: hashes of stems and words, and the stem that each is drawn towards."""

    def __init__(self, tokens: pa.Array):
        mark = pc.starts_with(tokens, "*")
        self.is_stem = mark.to_numpy(zero_copy_only=False)
        stems, words = pc.utf8_slice_codeunits(tokens.filter(mark), 1), tokens.filter(pc.invert(mark))
        self.stems, self.words = _hashed(stems, 22), _hashed(words, 21)
        self.order = np.argsort(self.stems)
        self.length = pc.utf8_length(stems).to_numpy()
        self.stem_parent, self.word_parent = self._parents(stems), self._parents(words)

    def _parents(self, tokens: pa.Array) -> np.ndarray:
        """Place of each token's longest shorter stem among the stems, or -1."""
        length = pc.utf8_length(tokens).to_numpy()
        out = np.full(len(tokens), -1, np.int64)
        rising = self.stems[self.order]
        for n in PREFIXES:  # a longer one replaces a shorter one
            some = np.flatnonzero(length > n)
            if len(some) and len(rising):
                hashed = _hashed(pc.utf8_slice_codeunits(tokens.take(pa.array(some)), 0, n), 22)
                i = np.minimum(np.searchsorted(rising, hashed), len(rising) - 1)
                hit = rising[i] == hashed
                out[some[hit]] = self.order[i[hit]]
        return out

    def model(self, other: np.ndarray, toxic: np.ndarray, all_other: float, all_toxic: float) -> Model:
        """Log-odds of every token against all text, parents first, and the decay of sums of them."""
        rest = math.log((all_toxic + 1) / (all_other + 1))
        base = 1 / (1 + math.exp(-rest))

        def smoothed(part: np.ndarray, parent: np.ndarray) -> np.ndarray:
            prior = np.where(parent >= 0, share[parent], base) if len(share) else np.full(len(parent), base)
            return (toxic[part] + PRIOR * prior) / (toxic[part] + other[part] + PRIOR)

        stems, words = np.flatnonzero(self.is_stem), np.flatnonzero(~self.is_stem)
        share = np.zeros(len(stems))  # toxic share of a stem's documents after smoothing
        for n in PREFIXES:
            some = self.length == n
            share[some] = smoothed(stems[some], self.stem_parent[some])
        odds = lambda p: np.log(p / (1 - p)) - rest
        of_words = odds(smoothed(words, self.word_parent))
        steps = np.append(of_words - DRIFT, -DRIFT)
        weight = np.append(other[words], max(1.0, all_other - other[words].sum()))
        rising = np.argsort(self.words)
        return Model(
            (self.words[rising], of_words[rising]), (self.stems[self.order], odds(share)[self.order]), 0.0, _decay(steps, weight / weight.sum()), ((), ())
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from at most about `sample` labelled documents.

    Tokens are counted on the executors; those of LEAST documents or more come to the
    driver, where the sample bounds their number.
    """
    rows = saved(training_rows(docs, labels, sample))
    kinds = ["other", "toxic", "other_apart", "toxic_apart"]
    counts = saved(
        rows.mapInArrow(frugal(_token_counts), "token string, " + ", ".join(f"{k} long" for k in kinds))
        .groupBy("token").agg(*(F.sum(k).alias(k) for k in kinds))
        .where(" + ".join(kinds) + f" >= {LEAST}")
    )
    top = counts.orderBy("token").toArrow().combine_chunks()
    token = top.column("token").combine_chunks() if top.num_rows else pa.array([], pa.string())
    o, t, oa, ta = (top.column(k).to_numpy().astype(float) for k in kinds)
    tokens = Tokens(token)
    total = [float(x[~tokens.is_stem].sum()) for x in (o, t, oa, ta)]
    if not total[1] + total[3] or not total[0] + total[2]:
        return Model.of({}, 0.0, 1.0)
    trial = tokens.model(o, t, total[0], total[1])
    model = tokens.model(o + oa, t + ta, total[0] + total[2], total[1] + total[3])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scored(trial)
        for b in by_bytes(batches, "text"):
            h = [round(heights(trial, *x)[0], 1) for x in scored.steps(t or "" for t in b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.float64()), b.column(1)], ["h", "toxic"])

    # at most `sample` documents, by rounded height
    points = (
        rows.where("apart").select("text", "toxic").mapInArrow(frugal(raw), "h double, toxic int")
        .groupBy("h").agg(F.sum(F.col("toxic").cast("double")).alias("t"), F.count("*").alias("n")).orderBy("h").toPandas()
    )
    model.knots = _isotonic(points["h"].to_numpy(float), points["t"].to_numpy(float), points["n"].to_numpy(float))
    return model


def _decay(steps: np.ndarray, weight: np.ndarray) -> float:
    """Positive root of sum(weight * exp(decay * steps)) = 1; the mean step is negative."""
    lo, hi = 0.0, 1.0
    value = lambda x: float(np.log((weight * np.exp(np.clip(x * steps, -700, 700))).sum()))
    if steps.max() <= 0:
        return 1.0
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 0 else (lo, mid)
    return hi


def _isotonic(h: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Rising shares of toxic by rising height: neighbours out of order are pooled. Knots are the pools' mean heights."""
    pools: list[list[float]] = []  # [height * n, toxic, n]
    for x, t, k in zip(h, toxic, n, strict=True):
        pools.append([x * k, t, k])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return tuple(p[0] / p[2] for p in pools), tuple((p[1] + 0.01) / (p[2] + 0.02) for p in pools)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted, passages.

    The score depends on the whole text alone. A null or empty text has the lowest height,
    that of no words. A null doc_id is not held out. passages are the significant segments in words of letters. Repeated
    rows are scored alike; further columns are ignored; an empty table gives an empty
    result, and so does scoring with a model fitted on no toxic documents: low scores.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # tokens of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scored = Scored(m)
        for b in by_bytes(batches, "text"):
            found = [heights(m, *x) for x in scored.steps(t or "" for t in b.column(2).to_pylist())]
            p = [m.probability(h) for h, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(p, pa.float64()),
                    pa.array([int(x >= threshold) for x in p], pa.int32()),
                    pa.array(
                        [[{"first_word": a, "n_words": z - a, "height": h} for h, a, z in f] for _, _, f in found],
                        pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("height", pa.float64())])),
                    ),
                ],
                ["doc_id", "held_out", "score", "predicted", "passages"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        frugal(run), "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first_word: bigint, n_words: bigint, height: double>>"
    )
