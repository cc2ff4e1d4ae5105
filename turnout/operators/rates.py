"""Observed rates, mixes, bands and the rate-based baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.scalars import band, clip
from turnout.session import frozen, lookup

# Fixed values of the analysis.
MIN_SAMPLE = 25
SHRINK = 60.0
RATE_BANDS = ([-0.01, 0.4, 0.7, 1.01], ["low", "medium", "high"])
LEAD_BANDS = ([-0.01, 1.0, 7.0, 1e9], ["0-1 days", "2-7 days", "8+ days"])
MIX_BANDS = ([-0.01, 0.25, 0.6, 1.01], ["few courtesies", "mixed", "many courtesies"])


def y_num(y: str = "y") -> Column:
    return F.col(y).cast("int")


def rate_by(df: DataFrame, *by: str, minimum: int = MIN_SAMPLE) -> DataFrame:
    """Attendance rate of labelled rows per key, hiding small cells and absent keys."""
    rows = df.filter(F.col("y").isNotNull())
    for c in by:
        rows = rows.filter(F.col(c).isNotNull())
    return (
        rows.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y_num()).alias("attended"))
        .filter(F.col("n") >= minimum)
        .withColumn("rate", F.col("attended") / F.col("n"))
        .orderBy(F.desc("rate"), *by)
    )


def banded(df: DataFrame, column: str, bands, name: str) -> DataFrame:
    edges, labels = bands
    return df.withColumn(name, band(F.col(column), edges, labels))


def rates_in_sets(df: DataFrame, sets: list[str], minimum: int = 1) -> DataFrame:
    """Rates by several independent keys in one pass: (cut, value, n, rate).

    Each row is expanded to one (cut, value) pair per key, which partial
    aggregation collapses before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).cast("string").alias("value")) for c in sets])
    return (
        df.filter(F.col("y").isNotNull())
        .select(y_num().alias("yn"), F.explode(pairs).alias("k"))
        .select("yn", "k.cut", "k.value")
        .filter(F.col("value").isNotNull())
        .groupBy("cut", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("yn").alias("rate"))
        .filter(F.col("n") >= minimum)
    )


def mix_shares(df: DataFrame, by: str, of: str) -> DataFrame:
    """Row shares of a cross-tab in long form: (by, of, n, share)."""
    cells = df.groupBy(by, of).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(by).agg(F.sum("n").alias("total"))
    return cells.join(totals, by).select(by, of, "n", (F.col("n") / F.col("total")).alias("share"))


def expected_from_mix(df: DataFrame, by: str = "month") -> DataFrame:
    """Attendance rate implied by the ticket mix alone."""
    rates = type_rates(df.filter(F.col("y").isNotNull()))
    return (
        mix_shares(df, by, "ticket_type")
        .join(rates, "ticket_type")
        .groupBy(by)
        .agg(F.sum(F.col("share") * F.col("type_rate")).alias("expected_rate"))
    )


def month_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(
        F.count(F.lit(1)).alias("n_tickets"),
        F.countDistinct("event_id").alias("n_events"),
        F.count("y").alias("n_labelled"),
        F.avg(y_num()).alias("rate"),
    )


def history_rate_by_type(history: DataFrame) -> DataFrame:
    return history.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("used").cast("int")).alias("rate")
    )


def cells(train: DataFrame) -> DataFrame:
    """Tickets and entries per (artist, type): all that the rate models need to know."""
    return train.groupBy("artist_id", "ticket_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y_num()).alias("obs")
    )


def rates_of(cell: DataFrame) -> DataFrame:
    return cell.groupBy("ticket_type").agg((F.sum("obs") / F.sum("n")).alias("type_rate"))


def overall_of(cell: DataFrame):
    return cell.agg(F.sum("obs") / F.sum("n")).scalar()


def type_rates(train: DataFrame) -> DataFrame:
    return rates_of(cells(train))


def with_type_rate(df: DataFrame, cell: DataFrame) -> DataFrame:
    """Rate of the ticket type in `cell`; the overall rate for unseen types."""
    return df.join(lookup(rates_of(cell)), "ticket_type", "left").withColumn(
        "type_rate", F.coalesce("type_rate", overall_of(cell))
    )


def artist_factors(cell: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """Observed over expected attendance per artist, pulled towards 1 by `shrink` tickets."""
    return (
        cell.join(lookup(rates_of(cell)), "ticket_type")
        .groupBy("artist_id")
        .agg(F.sum("obs").alias("obs"), F.sum(F.col("n") * F.col("type_rate")).alias("expected"))
        .select("artist_id", ((F.col("obs") + shrink) / (F.col("expected") + shrink)).alias("factor"))
    )


class Baseline:
    """Contract shared with the fitted models: `fit(df)` then `predict(df)` adds column `p`."""

    name = "baseline"
    user_columns: list[str] | None = None  # of a user's own columns, those that p depends on; None: any

    def fit(self, train: DataFrame) -> "Baseline":
        # one pass over the tickets; what is kept has one row per (artist, type)
        return self.fit_cells(frozen(cells(train)))

    def fit_cells(self, cell: DataFrame) -> "Baseline":
        """As `fit`, from the `cells` of the tickets."""
        self.cell = cell
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class AllEnter(Baseline):
    name = "B0"

    def fit(self, train):
        return self

    def predict(self, df):
        return df.withColumn("p", F.lit(1.0))


class GlobalRate(Baseline):
    name = "B1"

    def predict(self, df):
        return df.withColumn("p", overall_of(self.cell))


class TypeRate(Baseline):
    name = "B2"

    def predict(self, df):
        return with_type_rate(df, self.cell).withColumnRenamed("type_rate", "p")


class TypeArtistRate(Baseline):
    name = "B3"
    user_columns = []

    def predict(self, df):
        rated = with_type_rate(df, self.cell).join(lookup(artist_factors(self.cell)), "artist_id", "left")
        p = clip(F.col("type_rate") * F.coalesce("factor", F.lit(1.0)), 1e-6, 1 - 1e-6)
        return rated.withColumn("p", p).drop("type_rate", "factor")


def leave_show_out(df: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """`df` with p from the type-and-artist rate of all labelled tickets but those of the same show.

    Exact in one pass: a show's own cells are taken from the totals. A type that only this
    show has gets the overall rate of the others.
    """
    own = frozen(df.groupBy("event_id", "artist_id", "ticket_type").agg(F.count(F.lit(1)).alias("n"), F.sum(y_num()).alias("obs")))
    by_type = own.groupBy("ticket_type").agg(F.sum("n").alias("t_n"), F.sum("obs").alias("t_obs"))
    by_artist = own.groupBy("artist_id", "ticket_type").agg(F.sum("n").alias("a_n"), F.sum("obs").alias("a_obs"))
    whole = own.agg(F.sum("n").alias("all_n"), F.sum("obs").alias("all_obs"))
    shows = own.groupBy("event_id", "artist_id").agg(F.sum("n").alias("e_n"), F.sum("obs").alias("e_obs"))
    # of every show all types of its artist, with what the show itself has of them
    grid = (
        shows.join(by_artist, "artist_id").join(by_type, "ticket_type")
        .join(own.select("event_id", "artist_id", "ticket_type", "n", "obs"), ["event_id", "artist_id", "ticket_type"], "left")
        .fillna(0, ["n", "obs"]).join(F.broadcast(whole), F.lit(True))  # one row
    )
    rest = F.col("t_n") - F.col("n")
    others = (F.col("all_obs") - F.col("e_obs")) / (F.col("all_n") - F.col("e_n"))
    grid = grid.withColumn("type_rate", F.when(rest > 0, (F.col("t_obs") - F.col("obs")) / rest).otherwise(others))
    factors = grid.groupBy("event_id", "artist_id").agg(
        ((F.sum(F.col("a_obs") - F.col("obs")) + shrink) / (F.sum((F.col("a_n") - F.col("n")) * F.col("type_rate")) + shrink)).alias("factor")
    )
    p = clip(F.col("type_rate") * F.col("factor"), 1e-6, 1 - 1e-6)
    rated = frozen(grid.join(factors, ["event_id", "artist_id"]).select("event_id", "artist_id", "ticket_type", p.alias("p")))
    return df.join(lookup(rated), ["event_id", "artist_id", "ticket_type"])


BASELINES = [AllEnter, GlobalRate, TypeRate, TypeArtistRate]


def observed_rates(df: DataFrame) -> DataFrame:
    """Courtesy rate per channel, and courtesy and paid rates: (rate_key, rate)."""
    lab = df.filter(F.col("y").isNotNull())
    per = lab.groupBy("is_courtesy", "channel").agg(F.sum(y_num()).alias("s"), F.count(F.lit(1)).alias("n"))
    by_channel = per.filter("is_courtesy").select(F.col("channel").alias("rate_key"), (F.col("s") / F.col("n")).alias("rate"))
    by_kind = per.groupBy("is_courtesy").agg((F.sum("s") / F.sum("n")).alias("rate")).select(
        F.when(F.col("is_courtesy"), "cortesia").otherwise("pagada").alias("rate_key"), "rate"
    )
    return by_channel.unionByName(by_kind)


def show_residuals(df: DataFrame) -> DataFrame:
    """Per past show: observed, expected from the type mix, and the relative residual.

    The tickets are read once; rates and expectations come from the cells of (show, type).
    """
    lab = df.filter(F.col("y").isNotNull())
    own = frozen(lab.groupBy("event_id", "artist_name", "ticket_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y_num()).alias("obs"), F.sum(F.col("is_courtesy").cast("int")).alias("courtesies")
    ))
    return (
        own.join(lookup(rates_of(own)), "ticket_type")
        .groupBy("event_id", "artist_name")
        .agg(
            F.sum("n").alias("n"),
            F.sum("obs").alias("obs"),
            F.sum(F.col("n") * F.col("type_rate")).alias("pred"),
            (F.sum("courtesies") / F.sum("n")).alias("courtesy_share"),
        )
        .withColumn("residual", (F.col("obs") - F.col("pred")) / F.col("n"))
    )


def largest_residuals(df: DataFrame, k: int = 6) -> DataFrame:
    return show_residuals(df).orderBy(F.desc(F.abs("residual")), "event_id").limit(k)


def artist_ratio(df: DataFrame) -> DataFrame:
    """Unshrunk observed/expected ratio per artist."""
    return (
        show_residuals(df)
        .groupBy("artist_name")
        .agg(F.sum("n").alias("n"), F.sum("obs").alias("obs"), F.sum("pred").alias("pred"))
        .withColumn("factor", F.col("obs") / F.col("pred"))
        .orderBy("factor", "artist_name")
    )
