"""Evaluation at ticket and at show level, for one or many models at once.

Every function reads a scored frame with `model`, `event_id`, `ticket_id`, `y`, `p`
and groups by `model`, so comparing models is one pass, not a loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.hashing import coefficients
from turnout.functions.scalars import clip
from turnout.operators.draws import uniforms
from turnout.operators.ordered import equal_count_bins, quantiles, running
from turnout.session import compute_partitions, frozen

SEED = 20260801


def named(df: DataFrame, model: str) -> DataFrame:
    return df.withColumn("model", F.lit(model))


def _yn():
    return F.col("y").cast("int")


def loss_metrics(df: DataFrame) -> DataFrame:
    q = clip(F.col("p"), 1e-9, 1 - 1e-9)
    ll = -(F.when(F.col("y"), F.log(q)).otherwise(F.log(1 - q)))
    return df.groupBy("model").agg(
        F.avg(ll).alias("log_loss"), F.avg((q - _yn()) * (q - _yn())).alias("brier")
    )


def calibration_table(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-count bins by predicted probability (ties by ticket id)."""
    slim = df.select("model", "ticket_id", "p", _yn().alias("yn"))
    binned = equal_count_bins(slim, [F.col("p"), F.col("ticket_id")], bins, "bin", by=["model"])
    return binned.groupBy("model", "bin").agg(
        F.avg("p").alias("mean_p"), F.avg("yn").alias("observed"), F.count(F.lit(1)).alias("n")
    )


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))
    return calibration_table(df, bins).groupBy("model").agg((F.sum(gap) / F.sum("n")).alias("ece"))


def ranking_metrics(df: DataFrame) -> DataFrame:
    """ROC AUC (ties count half) and average precision; NULL with a single class."""
    scores = df.groupBy("model", "p").agg(F.sum(_yn()).alias("pos"), F.sum(1 - _yn()).alias("neg"))
    cum = running(scores, [F.desc("p")], by=["model"], rank=None, sums={"tp": "pos", "fp": "neg"})
    got = cum.groupBy("model").agg(
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)).alias("area"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"),
    )
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return got.select(
        "model",
        F.when(both, F.col("area") / (F.col("P").cast("double") * F.col("N"))).alias("auc_roc"),
        F.when(both, F.col("steps") / F.col("P")).alias("auc_pr"),
    )


def ticket_metrics(df: DataFrame) -> DataFrame:
    return loss_metrics(df).join(ece(df), "model").join(ranking_metrics(df), "model")


def by_event(df: DataFrame) -> DataFrame:
    return df.groupBy("model", "event_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_yn()).alias("obs"),
        F.sum("p").alias("pred"),
        F.avg(F.col("is_courtesy").cast("int")).alias("courtesy_share"),
    )


def event_metrics(df: DataFrame) -> DataFrame:
    err = F.col("pred") - F.col("obs")
    ev = by_event(df).withColumns({"err": err, "ae": F.abs(err)})
    means = ev.groupBy("model").agg(
        F.avg("ae").alias("mae"),
        F.avg(F.col("ae") / F.greatest(F.col("obs"), F.lit(1))).alias("mape"),
        F.avg("err").alias("bias"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return means.join(quantiles(ev, "ae", {"median_ae": 0.5, "p90_ae": 0.9}, by=["model"]), "model")


#: Events of a block, replicates that a task draws, draws made at once.
BLOCK, CHUNK, AT_ONCE = 1 << 16, 50, 1 << 18


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model's values in a block, by position; positions that it has no event at are NaN."""
    for b in batches:
        for i in range(b.num_rows):
            rows = b.column(2).slice(i, 1).flatten()
            x = np.full(BLOCK, np.nan)
            x[rows.field(0).to_numpy() - 1 - BLOCK * b.column(1)[i].as_py()] = rows.field(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([x.tobytes()], pa.binary())], ["model", "block", "x"])


def _resampled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                lo = BLOCK * r["block"]
                size = min(BLOCK, n - lo)
                values = np.array([np.frombuffer(v["x"])[:size] for v in r["values"]])
                known = ~np.isnan(values)
                values = np.where(known, values, 0.0)
                out = []
                for rep in r["reps"]:
                    c = np.array([[rep[f"c{k}"]] for k in range(4)], np.int64)
                    times = np.zeros(size, np.int64)
                    for first in range(0, n, AT_ONCE):
                        at = np.floor(uniforms(c, np.arange(first, min(first + AT_ONCE, n))) * n).astype(np.int64) - lo
                        times += np.bincount(at[(at >= 0) & (at < size)], minlength=size)
                    out += [(v["model"], rep["rep"], float(s), int(m)) for v, s, m in zip(r["values"], values @ times, known @ times)]
                cols = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.int64()))], ["model", "rep", "s", "m"])

    return run


def bootstrap_mean(ev: DataFrame, value: str, reps: int = 4000, seed: int = SEED) -> DataFrame:
    """95 % interval of the mean of `value`, resampling events with replacement.

    All models share the draws. A replicate is how often each event is drawn: tasks draw the
    positions of a chunk of replicates and add up the values of a block of events, so that
    no draw becomes a row and one row for each model, replicate and block is shuffled.
    """
    spark = ev.sparkSession
    ranked = running(ev.select("event_id").distinct(), [F.col("event_id")], rank="pos")
    values = ev.select("model", "event_id", F.col(value).cast("double").alias("v")).join(ranked, "event_id")
    block = F.floor((F.col("pos") - 1) / BLOCK).cast("int").alias("block")
    packed = values.groupBy("model", block).agg(F.collect_list(F.struct("pos", "v")).alias("rows")).mapInArrow(_packed, "model string, block int, x binary")
    blocks = frozen(packed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("model", "x"))).alias("values")))
    n = ranked.count()
    rep = F.struct(F.col("id").alias("rep"), *[c.alias(f"c{i}") for i, c in enumerate(coefficients(F.lit(seed), F.lit("boot"), F.col("id")))])
    chunks = spark.range(reps).groupBy(F.floor(F.col("id") / CHUNK).alias("chunk")).agg(F.collect_list(rep).alias("reps"))
    last = blocks.agg(F.coalesce(F.max("block"), F.lit(0))).scalar()
    pairs = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), last))).join(blocks, "block")
    drawn = pairs.repartition(compute_partitions(spark), "chunk", "block").select("block", "values", "reps").mapInArrow(_resampled(n), "model string, rep long, s double, m long")
    per_rep = drawn.groupBy("model", "rep").agg((F.sum("s") / F.sum("m")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return per_rep.groupBy("model").agg(q.alias("q")).select(
        "model", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high")
    )


def bootstrap_mae(df: DataFrame, reps: int = 4000, seed: int = SEED) -> DataFrame:
    ev = frozen(by_event(df).withColumn("ae", F.abs(F.col("pred") - F.col("obs"))))
    mae = ev.groupBy("model").agg(F.avg("ae").alias("mae"))
    return mae.join(bootstrap_mean(ev, "ae", reps, seed), "model")


def paired_difference(df: DataFrame, rival: str, reps: int = 4000, seed: int = SEED) -> DataFrame:
    """Per model: mean difference of absolute event errors against `rival` on the same events."""
    ev = frozen(by_event(df).withColumn("ae", F.abs(F.col("pred") - F.col("obs"))))
    base = ev.filter(F.col("model") == rival).select("event_id", F.col("ae").alias("rival_ae"))
    dif = ev.filter(F.col("model") != rival).join(base, "event_id").withColumn("dif", F.col("ae") - F.col("rival_ae"))
    mean = dif.groupBy("model").agg(F.avg("dif").alias("mean_dif"))
    ci = bootstrap_mean(dif, "dif", reps, seed)
    return mean.join(ci, "model").withColumn(
        "conclusive", (F.round("ci_low", 9) > 0) | (F.round("ci_high", 9) < 0)  # a zero may come as its last bit
    )


def error_by_segment(df: DataFrame, cuts: list[str] | None = None) -> DataFrame:
    """Bias and mean absolute error by independent binary cuts, in one pass."""
    cuts = cuts or ["is_courtesy", "is_residency", "linked"]
    pairs = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).alias("value")) for c in cuts])
    return (
        df.select("model", (F.col("p") - _yn()).alias("err"), F.explode(pairs).alias("k"))
        .select("model", "err", "k.cut", "k.value")
        .filter(F.col("value").isNotNull())
        .groupBy("model", "cut", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("err").alias("mean_bias"),
            F.avg(F.abs("err")).alias("mean_abs_error"),
        )
    )


def fold_spread(df: DataFrame) -> DataFrame:
    """Sample deviation over folds of the event MAE."""
    per = df.groupBy("model", "fold", "event_id").agg(F.abs(F.sum("p") - F.sum(_yn())).alias("ae"))
    return per.groupBy("model", "fold").agg(F.avg("ae").alias("mae")).groupBy("model").agg(
        F.stddev_samp("mae").alias("mae_std_folds")
    )


def cv_table(oof: DataFrame, reps: int = 4000) -> DataFrame:
    """One row per model: all metrics on out-of-fold predictions, with the bootstrap interval."""
    return (
        ticket_metrics(oof)
        .join(event_metrics(oof), "model")
        .join(bootstrap_mae(oof, reps).drop("mae"), "model")
        .join(fold_spread(oof), "model")
    )


def best_baseline(table: DataFrame) -> DataFrame:
    """The model with the smallest MAE among those whose name starts with B."""
    return table.filter(F.col("model").startswith("B")).agg(
        F.min_by("model", F.struct("mae", "model")).alias("model"), F.min("mae").alias("mae")
    )


def interval_scores(iv: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Coverage, width and Winkler score of (kind, lo, hi, obs) rows."""
    width = F.col("hi") - F.col("lo")
    miss = F.greatest(F.col("lo") - F.col("obs"), F.lit(0.0)) + F.greatest(F.col("obs") - F.col("hi"), F.lit(0.0))
    return iv.groupBy("kind").agg(
        F.avg(F.col("obs").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"),
        F.avg(width).alias("width"),
        F.avg(width + F.lit(2.0 / alpha) * miss).alias("winkler"),
        F.count(F.lit(1)).alias("n"),
    )
