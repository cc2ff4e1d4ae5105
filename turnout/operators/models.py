"""Fitted attendance models on Spark ML, behind the contract of `rates.Baseline`."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.operators import trees as T
from turnout.operators.ordered import quantiles, running
from turnout.operators.rates import BASELINES, Baseline
from turnout.operators.side_by_side import fit as fit_side_by_side
from turnout.operators.splits import event_folds
from turnout.session import frozen, lookup, stored

# Penalties of the segmented model.
L2_BASE = 1e-3
L2_ARTIST = 12.0
SEED = 20260801
PARALLEL_FITS = 8

CHANNELS = [("ch_box", "BOX_OFFICE"), ("ch_admin", "ADMIN"), ("ch_rrpp", "RRPP")]
COURTESY_DESIGN = ["linked_f", "has_rate", "rate_c", "log_n", "member", "city_f", "last_day"] + [c for c, _ in CHANNELS]
PAID_DESIGN = ["preferred", "vip", "last_day"] + [c for c, _ in CHANNELS]


def _flag(c):
    return F.coalesce(c, F.lit(False)).cast("double")


def design(df: DataFrame, segment: str) -> DataFrame:
    """Design columns of one segment (the intercept is the solver's) beside the input."""
    cols = {"last_day": _flag(F.col("lead_days") <= 1)}
    cols.update({name: _flag(F.col("channel") == v) for name, v in CHANNELS})
    if segment == "courtesy":
        rate = F.col("rate_minimum")
        cols.update(
            {
                "linked_f": _flag(F.col("linked")),
                "has_rate": rate.isNotNull().cast("double"),
                "rate_c": F.coalesce(rate - F.lit(0.75), F.lit(0.0)),
                "log_n": F.log1p(F.coalesce(F.col("n_history"), F.lit(0)).cast("double")) / F.lit(3.0),
                "member": _flag(F.col("has_membership")),
                "city_f": _flag(F.col("same_city")),
            }
        )
    else:
        cols.update(
            {
                "preferred": _flag(F.col("ticket_type") == "Preferencial"),
                "vip": _flag(F.col("ticket_type") == "VIP"),
            }
        )
    return df.filter(F.col("is_courtesy") == (segment == "courtesy")).withColumns(cols)


SEGMENTS = {"courtesy": COURTESY_DESIGN, "paid": PAID_DESIGN}


def design_cells(df: DataFrame, segment: str, *keys: str) -> DataFrame:
    """Labelled rows reduced to distinct design rows with counts of both outcomes.

    The likelihood depends on nothing else, so the solver iterates over this small
    table instead of the tickets.
    """
    yn = F.col("y").cast("int")
    return (
        design(df.filter(F.col("y").isNotNull()), segment)
        .groupBy(*keys, "artist_id", *SEGMENTS[segment])
        .agg(F.sum(yn).cast("double").alias("pos"), F.sum(1 - yn).cast("double").alias("neg"))
    )


def _encoder(cells: DataFrame, cols: list[str]):
    """Features: base columns, then shrunk artist indicators.

    An indicator multiplied by sqrt(base/artist penalty) under one common penalty
    is penalised as if it had its own. Unseen artists are all zeros.
    """
    text = cells.withColumn("artist_key", F.col("artist_id").cast("string"))
    index = StringIndexer(inputCol="artist_key", outputCol="artist_ix", handleInvalid="keep", stringOrderType="alphabetAsc").fit(text)
    n = len(index.labels)
    scale = math.sqrt(L2_BASE / L2_ARTIST)
    stages = [
        index,
        OneHotEncoder(inputCol="artist_ix", outputCol="artist_hot", dropLast=True),
        ElementwiseProduct(scalingVec=Vectors.dense([scale] * n), inputCol="artist_hot", outputCol="artist_scaled"),
        VectorAssembler(inputCols=[*cols, "artist_scaled"], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(text), index.labels, scale


def _weighted_rows(cells: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("pos").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), F.col("neg").alias("weight")),
    )
    return cells.withColumn("o", F.explode(both)).withColumns(
        {"label": F.col("o.label"), "weight": F.col("o.weight")}
    ).filter("weight > 0").drop("o")


def _solve(rows: DataFrame, total: float):
    return LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=100, tol=1e-7,
        regParam=L2_BASE / max(total, 1.0), elasticNetParam=0.0, standardization=False, fitIntercept=True,
    ).fit(rows)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("artist_key", F.col("artist_id").cast("string"))


def _score(df: DataFrame, segment: str, encoder, model) -> DataFrame:
    keep = df.columns
    x = encoder.transform(_keyed(design(df, segment)))
    return model.transform(x).withColumn("p", vector_to_array("probability")[1]).select(*keep, "p")


class SegmentedLogistic(Baseline):
    """Two logistic models, courtesy and paid, each with shrunk artist effects."""

    name = "M1"
    user_columns = ["n_history", "rate_minimum", "has_membership"]

    def fit(self, train: DataFrame) -> "SegmentedLogistic":
        self.parts = {}

        def one(segment):
            cells = frozen(design_cells(train, segment))
            encoder, labels, scale = _encoder(cells, SEGMENTS[segment])
            total = cells.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] or 0.0
            model = _solve(encoder.transform(_keyed(_weighted_rows(cells))), total)
            return segment, (encoder, model, labels, scale)

        with ThreadPoolExecutor(2) as pool:
            self.parts = dict(pool.map(one, SEGMENTS))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = None
        for segment, (encoder, model, _, _) in self.parts.items():
            one = _score(df, segment, encoder, model)
            out = one if out is None else out.unionByName(one)
        return out

    def coefficients(self, spark) -> DataFrame:
        rows = []
        for segment, (_, model, labels, scale) in self.parts.items():
            w = model.coefficients.toArray()
            base = SEGMENTS[segment]
            rows.append((segment, "intercept", float(model.intercept)))
            rows += [(segment, c, float(w[i])) for i, c in enumerate(base)]
            rows += [(segment, f"art:{a}", float(w[len(base) + i] * scale)) for i, a in enumerate(labels)]
        return spark.createDataFrame(rows, "segment string, term string, weight double")

    def slopes(self, df: DataFrame) -> DataFrame:
        """(segment, term, slope, n): derivative of the penalised likelihood of `df` by each weight."""
        weights = self.coefficients(df.sparkSession)
        out = None
        for segment, cols in SEGMENTS.items():
            x = design(df.filter(F.col("y").isNotNull()), segment)
            terms = F.array(
                F.struct(F.lit("intercept").alias("term"), F.lit(1.0).alias("x")),
                F.struct(F.concat(F.lit("art:"), F.col("artist_id").cast("string")).alias("term"), F.lit(1.0).alias("x")),
                *[F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("x")) for c in cols],
            )
            miss = F.col("y").cast("int") - F.col("p")
            sums = (
                self.predict(x).select(miss.alias("miss"), F.explode(terms).alias("t"))
                .groupBy("t.term").agg(F.sum(F.col("miss") * F.col("t.x")).alias("s"))
            )
            n = x.agg(F.count(F.lit(1))).scalar()
            w = weights.filter(F.col("segment") == segment)
            pull = F.when(F.col("term") == "intercept", 0.0).when(F.col("term").startswith("art:"), L2_ARTIST).otherwise(L2_BASE)
            one = w.join(sums, "term").select("segment", "term", (F.col("s") - pull * F.col("weight")).alias("slope"), n.alias("n"))
            out = one if out is None else out.unionByName(one)
        return out


def held_out_scores(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Score every labelled ticket with a segmented model that never saw its group.

    `groups` maps event_id to `fold`; one fold per show is leave-one-show-out. The design
    cells are built once; all folds are fitted side by side, and their weights, which stay
    rows, meet the tickets in one join on the fold.
    """
    lab = df.filter(F.col("y").isNotNull()).join(groups, "event_id")
    folds = frozen(groups.select("fold").distinct())
    artists = frozen(running(lab.select("artist_id").distinct(), [F.col("artist_id")], rank="ix").select("artist_id", (F.col("ix") - 1).cast("int").alias("artist")))
    n_artists = artists.count()

    def one(segment: str) -> DataFrame:
        cols = SEGMENTS[segment]
        cells = frozen(design_cells(lab, segment, "fold").join(lookup(artists), "artist_id").drop("artist_id"))
        weights = fit_side_by_side(cells, folds, cols, n_artists, L2_BASE, L2_ARTIST)
        x = design(lab, segment).join(lookup(artists), "artist_id").join(weights, "fold")
        z = F.col("w")[0]
        for i, c in enumerate(cols):
            z = z + F.col("w")[i + 1] * F.col(c)
        z = z + F.get("w", F.col("artist") + (1 + len(cols)))
        return x.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).select(*lab.columns, "p")

    with ThreadPoolExecutor(2) as pool:
        courtesy, paid = pool.map(one, SEGMENTS)
    return courtesy.unionByName(paid)


def leave_show_out(df: DataFrame, folds: int | None = None) -> DataFrame:
    """Held-out scores by one fit per show, whatever their number; with `folds`, by that
    many groups of shows. Either way no show is scored by a model that saw it."""
    shows = df.filter(F.col("y").isNotNull()).select("event_id").distinct()
    groups = shows.withColumn("fold", F.col("event_id")) if folds is None else event_folds(shows, k=folds)
    return held_out_scores(df, frozen(groups))


# Columns of the single-model candidates.
CATEGORICAL = ["ticket_type", "channel", "artist_id", "weekday", "city"]
NUMERIC = ["rate_minimum", "rate_membership", "n_history", "n_minimum", "lead_days", "qty", "price", "capacity", "confidence"]
BOOLEAN = ["is_courtesy", "linked", "has_membership", "same_city", "is_residency", "is_paid"]
DERIVED = ["c_rate", "c_linked", "c_log_n", "c_city", "c_member", "last_day", "c_last_day"]
MIN_FREQUENCY = 30


def interactions(df: DataFrame) -> DataFrame:
    """Input plus the courtesy interactions."""
    c = _flag(F.col("is_courtesy"))
    last = (F.coalesce(F.col("lead_days"), F.lit(99.0)) <= 1).cast("double")
    return df.withColumns(
        {
            "c_rate": c * F.coalesce("rate_minimum", F.lit(0.75)),
            "c_linked": c * _flag(F.col("linked")),
            "c_log_n": c * F.log1p(F.col("n_history").cast("double")),
            "c_city": c * _flag(F.col("same_city")),
            "c_member": c * _flag(F.col("has_membership")),
            "last_day": last,
            "c_last_day": c * last,
        }
    )


class _Prepared:
    """Encoding shared by M2-M4: rare categories pooled, medians imputed, optional z-scores."""

    def __init__(self, train: DataFrame, scale: bool):
        x = interactions(train)
        numbers = NUMERIC + BOOLEAN + DERIVED
        pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in CATEGORICAL])
        counts = (
            x.select(F.explode(pairs).alias("k")).groupBy("k.col", "k.val").count()
            .select("col", "val", F.when(F.col("count") >= MIN_FREQUENCY, F.concat(F.lit("v:"), "val")).otherwise(F.lit("rare")).alias("enc"))
        )
        self.vocabulary = lookup(frozen(counts))  # else tickets move once for each column
        # exact medians of all columns in one pass: distinct (column, value), with counts, ranked across partitions
        values = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in numbers])).alias("k")).select("k.*")
        med = {r["col"]: r["m"] for r in quantiles(values, "v", {"m": 0.5}, by=["col"]).collect()}  # a row per column
        self.fill = {c: float(med.get(c) or 0.0) for c in numbers}
        filled = self._numbers(x)
        self.moments = None
        if scale:
            m = filled.agg(*[F.avg(f"n_{c}").alias(f"m_{c}") for c in numbers], *[F.stddev_pop(f"n_{c}").alias(f"s_{c}") for c in numbers]).first()
            self.moments = {c: (float(m[f"m_{c}"]), float(m[f"s_{c}"]) or 1.0) for c in numbers}
        coded = self._codes(self._numbers(x))
        # one indexer for all columns: their values are counted in a single pass
        stages = [
            StringIndexer(inputCols=[f"e_{c}" for c in CATEGORICAL], outputCols=[f"i_{c}" for c in CATEGORICAL], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"i_{c}" for c in CATEGORICAL], outputCols=[f"h_{c}" for c in CATEGORICAL], dropLast=True),
        ]
        stages.append(VectorAssembler(inputCols=[*[f"h_{c}" for c in CATEGORICAL], *[f"n_{c}" for c in numbers]], outputCol="features"))
        self.pipeline = Pipeline(stages=stages).fit(coded)

    def _numbers(self, x: DataFrame) -> DataFrame:
        cols = {}
        for c, fill in self.fill.items():
            v = F.coalesce(F.col(c).cast("double"), F.lit(fill))
            if getattr(self, "moments", None):
                mean, sd = self.moments[c]
                v = (v - F.lit(mean)) / F.lit(sd)
            cols[f"n_{c}"] = v
        return x.withColumns(cols)

    def _codes(self, x: DataFrame) -> DataFrame:
        for c in CATEGORICAL:
            words = self.vocabulary.filter(F.col("col") == c).select(F.col("val").alias(f"v_{c}"), F.col("enc").alias(f"e_{c}"))
            x = x.join(words, F.col(c).cast("string") == F.col(f"v_{c}"), "left").drop(f"v_{c}")
            x = x.fillna({f"e_{c}": "unseen"})
        return x

    def features(self, df: DataFrame) -> DataFrame:
        x = self.pipeline.transform(self._codes(self._numbers(interactions(df))))
        return x.select(*df.columns, "features")


class InteractionLogistic(Baseline):
    """One logistic model with explicit interactions, L2 with unit inverse strength."""

    name = "M2"

    def fit(self, train):
        self.prep = _Prepared(train, scale=True)
        # the solver keeps the rows itself
        x = self.prep.features(train).select("features", F.col("y").cast("double").alias("label"))
        self.model = LogisticRegression(
            regParam=1.0 / max(train.count(), 1), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8
        ).fit(x)
        return self

    def predict(self, df):
        x = self.model.transform(self.prep.features(df))
        return x.withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


class CalibratedTrees(Baseline):
    """Tree ensemble with isotonic calibration on show-grouped folds.

    Each of the folds calibrates the ensemble fitted on the others; a prediction is the
    average of the calibrated probabilities. A fit takes all labelled rows.
    """

    folds = 4
    kind = ""

    def __init__(self, size: int):
        self.size = size

    def every(self, train: DataFrame, job: int = 0) -> DataFrame:
        """What a fit reads: all labelled rows, with calibration folds that keep shows whole."""
        lab = train.filter(F.col("y").isNotNull()).drop("fold", "job")  # those of an outer loop
        return interactions(lab).join(event_folds(lab, self.folds), "event_id").select(F.lit(job).alias("job"), "fold", "y", *TREE_NUMBERS, *CATEGORICAL)

    def rows(self, train: DataFrame, job: int = 0) -> DataFrame:
        """A part of at most about T.SAMPLE rows of `train`, for a caller's trials; no fit reads it."""
        lab = train.filter(F.col("y").isNotNull())
        n = lab.count()
        if n > T.SAMPLE:
            lab = lab.filter(F.pmod(F.xxhash64(F.lit("sample"), "ticket_id"), F.lit(1_000_000)) < int(1_000_000 * T.SAMPLE / n))
        return self.every(lab, job)

    def fit(self, train):
        made = T.train(self.every(train), TREE_NUMBERS, CATEGORICAL, self.kind, self.size, self.folds)
        self.models = [r["model"] for r in made.orderBy("fit").collect()]  # one row for each calibration fold
        return self

    def predict(self, df):
        return T.predict(interactions(df), df.columns, TREE_NUMBERS, CATEGORICAL, self.models)


TREE_NUMBERS = NUMERIC + BOOLEAN + DERIVED


class BoostedTrees(CalibratedTrees):
    name, kind = "M3", "boosted"

    def __init__(self, max_iter: int = 300):
        super().__init__(max_iter)


class Forest(CalibratedTrees):
    name, kind = "M4", "forest"

    def __init__(self, num_trees: int = 400):
        super().__init__(num_trees)


def out_of_fold(models, df: DataFrame, k: int = 5) -> DataFrame:
    """Out-of-fold predictions of every model in one frame (model, fold, ticket_id, y, p, ...)."""
    keep = ["ticket_id", "event_id", "is_courtesy", "is_residency", "y"] + [c for c in ("linked",) if c in df.columns]
    rates, fitted = [m for m in models if m in BASELINES], [m for m in models if m not in BASELINES]
    columns = df.columns if fitted else [*keep, "artist_id", "ticket_type"]
    x = stored(df.select(columns).join(event_folds(df, k), "event_id"))
    out = rates_out_of_fold(rates, x, k, keep) if rates else None

    def one(job):
        make, fold = job
        m = make()
        train, test = x.filter(F.col("fold") != fold), x.filter(F.col("fold") == fold)
        return m.fit(train).predict(test).select(F.lit(m.name).alias("model"), "fold", *keep, "p")

    jobs = [(make, fold) for make in fitted for fold in range(1, k + 1)]
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(one, jobs))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def rates_out_of_fold(models, x: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """As `out_of_fold` for rate models, whose p is that of the ticket's (artist, type).

    The tickets, which have their fold, are read twice, whatever the number of models and folds:
    once for the cells of every fold and once to give each ticket the p of all models.
    """
    cell = ["artist_id", "ticket_type"]
    own = frozen(x.groupBy("fold", *cell).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("int")).alias("obs")))

    def one(job):
        make, fold = job
        m = make()
        others = own.filter(F.col("fold") != fold).groupBy(*cell).agg(F.sum("n").alias("n"), F.sum("obs").alias("obs"))
        known = m.fit_cells(others).predict(own.filter(F.col("fold") == fold).select("fold", *cell))
        return known.select("fold", *cell, F.lit(m.name).alias("model"), "p")

    jobs = [(make, fold) for make in models for fold in range(1, k + 1)]
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(one, jobs))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy(F.col("fold").alias("of"), *[F.col(c).alias(f"c_{c}") for c in cell]).agg(F.collect_list(F.struct("model", "p")).alias("held"))
    same = (F.col("fold") == F.col("of")) & F.col("artist_id").eqNullSafe(F.col("c_artist_id")) & F.col("ticket_type").eqNullSafe(F.col("c_ticket_type"))
    return x.join(lookup(frozen(every)), same).select("fold", *keep, F.explode("held").alias("h")).select("h.model", "fold", *keep, "h.p")
