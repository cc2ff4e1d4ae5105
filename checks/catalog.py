"""Registered queries: the Spark side and, where SQL can say it, the oracle side.

All queries run over whole tables. Floating results are rounded to the same number
of places on both sides.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle as O
from checks.oracle import q
from turnout.functions import keys as K
from turnout.operators import arrival as A
from turnout.operators import decide as D
from turnout.operators import evaluate as E
from turnout.operators import features as FT
from turnout.operators import history as H
from turnout.operators import linkage as L
from turnout.operators import models as M
from turnout.operators import rates as R
from turnout.operators import simulate as S
from turnout.operators import splits as SP
from turnout.plans import experiment as X
from turnout.plans import report as RP
from turnout.session import frozen, scratch, stored
from turnout.sources import tables as T
from turnout.sources.adapter import AS_OF, star_tables

WEEKS = {"train": (1, 2), "val": (3,), "test": (4,)}
NOW = "2024-01-25 15:00:00"
MIN_P = 0.40  # the sample's courtesy rates lie below one half
SEED = S.SEED
SCORED = ["ticket_id", "sale_id", "event_id", "artist_name", "is_courtesy", "y", "p"]  # what simulations and decisions read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ------------------------------------------------------------- shared inputs
class Inputs:
    """Intermediate tables of one (session, folder), each built once and reused."""

    _all: dict = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.t = star_tables(spark, folder)
        self._memo: dict = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> "Inputs":
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._all:
            cls._all[key] = cls(spark, folder)
        return cls._all[key]

    def once(self, name: str, make):
        if name not in self._memo:
            self._memo[name] = make()
        return self._memo[name]

    @property
    def base(self):
        return FT.ticket_base(self.t, AS_OF)

    @property
    def lab(self):
        return self.base.filter("labelled")

    @property
    def future(self):
        return self.base.filter("not labelled")

    @property
    def links(self):
        return self.once("links", lambda: L.link(self.t.sales, self.t.users))

    @property
    def features(self):
        def make():
            with scratch(self.spark):
                return stored(FT.ticket_features(self.t, self.links, AS_OF), keep=True)

        return self.once("features", make)

    @property
    def parts(self):
        return SP.with_split(self.base, WEEKS)

    @property
    def dev(self):
        return self.parts.filter(F.col("split").isin("train", "val"))

    @property
    def test(self):
        return self.parts.filter("split = 'test'")

    @property
    def past3(self):
        return self.once("past3", lambda: stored(R.leave_show_out(self.lab).select(*SCORED)))

    @property
    def fut3(self):
        return self.once("fut3", lambda: stored(R.TypeArtistRate().fit(self.lab).predict(self.future).select(*SCORED)))

    @property
    def test3(self):
        return E.named(R.TypeArtistRate().fit(self.dev).predict(self.test), "B3")

    @property
    def test2(self):
        return E.named(R.TypeRate().fit(self.dev).predict(self.test), "B2")

    @property
    def shock(self):
        return self.once("shock", lambda: frozen(S.show_shock(S.event_residuals(self.past3))))

    @property
    def seats(self):
        return D.seats(S.forecast_facts(self.fut3), self.t.events)

    @property
    def curve(self):
        return A.arrival_curve(self.t.tickets, self.t.events)

    @property
    def eligible(self):
        return D.eligible_users(self.t.users, self.t.history, AS_OF)

    @property
    def chosen(self):
        def make():
            model = R.TypeArtistRate().fit(self.lab)
            eligible = frozen(self.eligible)

            def score(pairs):
                rows = D.hypothetical_tickets(pairs, self.t.events, eligible, AS_OF)
                return model.predict(rows).select("event_id", "user_id", "p").join(pairs, ["event_id", "user_id"])

            shows = self.seats.join(self.t.events.select("event_id", "city"), "event_id")
            held = D.holders(self.features.filter("not labelled"))
            return frozen(D.invite_candidates(eligible, shows, held, score, min_p=MIN_P, reads=model.user_columns))

        return self.once("chosen", make)

    @property
    def invite(self):
        return D.invite_lever(self.chosen, self.seats, self.t.events, AS_OF)

    @property
    def actions(self):
        return self.once("actions", lambda: frozen(D.actions(
            self.invite, D.channel_lever(self.future, self.seats, self.lab),
            D.convert_lever(self.future, self.seats, self.lab), self.seats)))

    @property
    def m1_held_out(self):
        return self.once("loo", lambda: stored(M.leave_show_out(self.features.filter("labelled"))))


def r(col, places=6):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, places)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every floating column."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------- sources and sinks
TABLE_NAMES = ("users", "history", "events", "sales", "tickets")


@query("scan_counts", q("""select 'users' as table_name, count(*) as n_rows from users union all select 'history', count(*) from history
   union all select 'events', count(*) from shows union all select 'sales', count(*) from sales union all select 'tickets', count(*) from tickets"""))
def scan_counts(spark, d):
    t = Inputs.of(spark, d).t
    return T.row_counts({n: t[n] for n in TABLE_NAMES})


def _shared_folder(spark, name):
    """A fresh folder inside the shared checkpoint folder."""
    import uuid

    from turnout.session import ensure_checkpoint_dir

    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("snapshot_roundtrip", q("""select channel, count(*) as n, sum(qty)::bigint as qty, count(purchased_at) as n_purchased,
   count(buyer_phone) as n_phone from sales group by 1"""))
def snapshot_roundtrip(spark, d):
    """JSON scan with a declared schema, Parquet snapshot, CSV sink and typed CSV scan."""
    t = Inputs.of(spark, d).t
    raw, snap, out = (_shared_folder(spark, n) for n in ("raw.jsonl", "snap", "csv"))
    t.sales.withColumn("sale_id", F.col("sale_id").cast("string")).write.json(raw + ".jsonl")
    stored = T.snapshot(spark, "sales", raw + ".jsonl", snap)
    cols = {c: c for c in ("sale_id", "channel", "qty", "purchased_at", "buyer_phone")}
    T.write_csv(stored, out, cols)
    back = T.read_csv(spark, out, "sale_id STRING, channel STRING, qty INT, purchased_at TIMESTAMP, buyer_phone STRING")
    n_phone = stored.groupBy("channel").agg(F.count("buyer_phone").alias("n_phone"))
    return back.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.count("purchased_at").alias("n_purchased")
    ).join(n_phone, "channel")


@query("fk_violations", q("""select 'tickets' as child, 'sale_id' as fk, 'sales' as parent, count(distinct sale_id) as dangling_keys, count(*) as dangling_rows
     from tickets where sale_id not in (select sale_id from sales)
   union all select 'tickets', 'event_id', 'events', count(distinct event_id), count(*) from tickets where event_id not in (select event_id from shows)
   union all select 'history', 'user_id', 'users', count(distinct user_id), count(*) from history where user_id not in (select user_id from users)"""))
def fk_violations(spark, d):
    return rounded(T.fk_violations(Inputs.of(spark, d).t))


@query("ticket_sale_event", q("""select ticket_id, sale_id, event_id, artist_id, ticket_type, is_courtesy, round(price, 2) as price, channel, qty,
   round(lead_days, 6) as lead_days, iso_week, venue, y from tb"""))
def ticket_sale_event(spark, d):
    return Inputs.of(spark, d).base.select("ticket_id", "sale_id", "event_id", "artist_id", "ticket_type", "is_courtesy",
                                           r("price", 2).alias("price"), "channel", "qty", r("lead_days").alias("lead_days"),
                                           "iso_week", "venue", "y")


# ------------------------------------------------------------- splits and rates
@query("label_split", q("select labelled, count(*) as n, count(distinct event_id) as n_events from tb group by 1"))
def label_split(spark, d):
    b = Inputs.of(spark, d).base
    return b.groupBy("labelled").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_events"))


@query("segment_split", q("""select case when is_courtesy then 'courtesy' else 'paid' end as segment, count(*) as n, count(y) as n_labelled,
   round(avg(yn), 6) as rate from tb group by 1"""))
def segment_split(spark, d):
    b = Inputs.of(spark, d).base
    return b.groupBy(F.when(F.col("is_courtesy"), "courtesy").otherwise("paid").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count("y").alias("n_labelled"), r(F.avg(R.y_num())).alias("rate"))


@query("week_split", q("select event_id, split, count(*) as n from parts where split is not null group by 1, 2"))
def week_split(spark, d):
    return SP.temporal_split(Inputs.of(spark, d).base, WEEKS).groupBy("event_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("split_summary", q("""select split, array_to_string(list_sort(list(distinct iso_week)), ',') as weeks, count(distinct event_id) as n_events,
   count(*) as n_tickets, round(avg(cast(is_courtesy as int)), 3) as courtesy_share, round(avg(yn), 4) as rate
   from parts where split is not null group by 1"""))
def split_summary(spark, d):
    return SP.split_summary(Inputs.of(spark, d).parts)


# planted leak: every tenth show also counts in the test part for half of its sales
_LEAKY = "case when event_id % 10 = 0 and sale_id % 2 = 0 then 'test' else split end"


@query("split_leaks", q(f"""select event_id, array_to_string(list_sort(list(distinct s)), ',') as splits
   from (select event_id, {_LEAKY} as s from parts where split is not null) group by 1 having count(distinct s) > 1"""))
def split_leaks(spark, d):
    planted = Inputs.of(spark, d).parts.filter(F.col("split").isNotNull()).withColumn("split", F.expr(_LEAKY))
    return SP.leaks(planted).withColumn("splits", F.array_join("splits", ","))


@query("split_unused", q("select count(*) filter (split is null) as n_unused, count(*) as n_labelled from parts"))
def split_unused(spark, d):
    return SP.unused_rows(Inputs.of(spark, d).parts)


def _rate_sql(by, minimum=25, src="lab"):
    return f"select {by}, count(*) as n, sum(yn)::bigint as attended, round(avg(yn), 6) as rate from {src} where {by} is not null group by 1 having count(*) >= {minimum}"


@query("rate_by_type", q(_rate_sql("ticket_type")))
def rate_by_type(spark, d):
    return rounded(R.rate_by(Inputs.of(spark, d).base, "ticket_type"))


@query("rate_by_channel", q(_rate_sql("channel", src="(select * from lab where is_courtesy)")))
def rate_by_channel(spark, d):
    return rounded(R.rate_by(Inputs.of(spark, d).base.filter("is_courtesy"), "channel"))


@query("rate_by_lead_band", q("""select lead_band, count(*) as n, sum(yn)::bigint as attended, round(avg(yn), 6) as rate from (
   select *, case when lead_days > -0.01 and lead_days <= 1 then '0-1 days' when lead_days > 1 and lead_days <= 7 then '2-7 days'
     when lead_days > 7 and lead_days <= 1e9 then '8+ days' end as lead_band from lab where is_courtesy)
   where lead_band is not null group by 1 having count(*) >= 25"""))
def rate_by_lead_band(spark, d):
    b = R.banded(Inputs.of(spark, d).base.filter("is_courtesy"), "lead_days", R.LEAD_BANDS, "lead_band")
    return rounded(R.rate_by(b, "lead_band"))


@query("rate_by_bands", q("""select is_courtesy, rate_band, count(*) as n, sum(yn)::bigint as attended, round(avg(yn), 6) as rate from (
   select *, case when rate_minimum > -0.01 and rate_minimum <= 0.4 then 'low' when rate_minimum > 0.4 and rate_minimum <= 0.7 then 'medium'
     when rate_minimum > 0.7 and rate_minimum <= 1.01 then 'high' end as rate_band from feat where labelled)
   where rate_band is not null group by 1, 2"""))
def rate_by_bands(spark, d):
    b = R.banded(Inputs.of(spark, d).features, "rate_minimum", R.RATE_BANDS, "rate_band")
    return rounded(R.rate_by(b, "is_courtesy", "rate_band", minimum=1))


@query("rate_grouping_sets", q("""select cut, value, count(*) as n, round(avg(yn), 6) as rate from (
   select yn, 'channel' as cut, channel as value from feat where labelled and is_courtesy
   union all select yn, 'same_city', cast(same_city as varchar) from feat where labelled and is_courtesy
   union all select yn, 'has_membership', cast(has_membership as varchar) from feat where labelled and is_courtesy)
   where value is not null group by 1, 2"""))
def rate_grouping_sets(spark, d):
    return rounded(R.rates_in_sets(Inputs.of(spark, d).features.filter("is_courtesy"), ["channel", "same_city", "has_membership"]))


@query("observed_rates", q("select rate_key, round(rate, 6) as rate from obs_rates"))
def observed_rates(spark, d):
    return rounded(R.observed_rates(Inputs.of(spark, d).base))


@query("history_rate_by_type", q("select type, count(*) as n, round(avg(cast(used as int)), 6) as rate from history group by 1"))
def history_rate_by_type(spark, d):
    return rounded(R.history_rate_by_type(Inputs.of(spark, d).t.history))


@query("mix_by_month", q("""select month, ticket_type, count(*) as n, round(count(*) / sum(count(*)) over (partition by month), 6) as share from tb group by 1, 2"""))
def mix_by_month(spark, d):
    return rounded(R.mix_shares(Inputs.of(spark, d).base, "month", "ticket_type"))


@query("month_summary", q("""select month, count(*) as n_tickets, count(distinct event_id) as n_events, count(y) as n_labelled, round(avg(yn), 6) as rate from tb group by 1"""))
def month_summary(spark, d):
    return rounded(R.month_summary(Inputs.of(spark, d).base))


@query("expected_from_mix", q("""select month, round(sum(share * r), 6) as expected_rate from (
   select month, ticket_type, count(*) / sum(count(*)) over (partition by month) as share from tb group by 1, 2) join all_type using (ticket_type) group by 1"""))
def expected_from_mix(spark, d):
    return rounded(R.expected_from_mix(Inputs.of(spark, d).base))


_RESID = """select event_id, artist_name, count(*) as n, sum(yn)::bigint as obs, sum(r) as pred, avg(cast(is_courtesy as int)) as courtesy_share,
   (sum(yn) - sum(r)) / count(*) as residual from lab join all_type using (ticket_type) group by 1, 2"""
_RESID_R = "event_id, artist_name, n, obs, round(pred, 6) as pred, round(courtesy_share, 6) as courtesy_share, round(residual, 6) as residual"


@query("show_residuals", q(f"select {_RESID_R} from ({_RESID})"))
def show_residuals(spark, d):
    return rounded(R.show_residuals(Inputs.of(spark, d).base))


@query("largest_residuals", q(f"select {_RESID_R} from ({_RESID}) order by abs(residual) desc, event_id limit 6"))
def largest_residuals(spark, d):
    return rounded(R.largest_residuals(Inputs.of(spark, d).base))


@query("artist_factor", q(f"""select artist_name, sum(n)::bigint as n, sum(obs)::bigint as obs, round(sum(pred), 6) as pred,
   round(sum(obs) / sum(pred), 6) as factor from ({_RESID}) group by 1"""))
def artist_factor(spark, d):
    return rounded(R.artist_ratio(Inputs.of(spark, d).base))


# ------------------------------------------------------------- baselines
def _baseline(cls):
    def run(spark, d):
        i = Inputs.of(spark, d)
        p = cls().fit(i.dev).predict(i.test)
        return rounded(p.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("pred"), F.sum(R.y_num()).alias("obs")))

    return run


_BASE_SQL = "select event_id, count(*) as n, round(sum({p}), 6) as pred, sum(yn)::bigint as obs from {src} group by 1"
query("baseline_b0", q(_BASE_SQL.format(p="1.0", src="parts where split = 'test'")))(_baseline(R.AllEnter))
query("baseline_b1", q(_BASE_SQL.format(p="(select avg(yn) from dev)", src="parts where split = 'test'")))(_baseline(R.GlobalRate))
query("baseline_b2", q(_BASE_SQL.format(p="p", src="test2")))(_baseline(R.TypeRate))
query("baseline_b3", q(_BASE_SQL.format(p="p", src="test3")))(_baseline(R.TypeArtistRate))

_FOLDS = f"""select event_id, ntile(5) over (order by {O.h31(SEED, 'event_id')}, event_id) as fold from (select distinct event_id from lab)"""


@query("grouped_folds", q("select event_id, cast(fold as int) as fold from folds", folds=_FOLDS))
def grouped_folds(spark, d):
    return SP.event_folds(Inputs.of(spark, d).lab, 5)


@query("fold_holdout", q("""select cast(fold as int) as fold, count(*) as n_test, count(distinct event_id) as n_events,
   (select count(*) from lab) - count(*) as n_train from lab join folds using (event_id) group by 1""", folds=_FOLDS))
def fold_holdout(spark, d):
    lab = Inputs.of(spark, d).lab
    x = SP.with_folds(lab, 5)
    per = x.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"), F.countDistinct("event_id").alias("n_events"))
    total = lab.agg(F.count(F.lit(1))).scalar()
    return per.withColumn("n_train", total - F.col("n_test"))


# ------------------------------------------------------------- keys
@query("norm_email", q(r"""select sale_id, email, local, dom, core from ns"""))
def norm_email(spark, d):
    return L.normalise_sales(Inputs.of(spark, d).t.sales).select("sale_id", "email", "local", "dom", "core")


@query("norm_phone", q("select sale_id, phone from ns"))
def norm_phone(spark, d):
    return Inputs.of(spark, d).t.sales.select("sale_id", K.norm_phone(F.col("buyer_phone")).alias("phone"))


@query("name_key", q(f"select sale_id, array_to_string(list_sort({O.tokens_of('buyer_name')}), ' ') as name_key from sales"))
def name_key(spark, d):
    return Inputs.of(spark, d).t.sales.select("sale_id", K.name_key(F.col("buyer_name")).alias("name_key"))


@query("phone_swaps", q(f"""select user_id, array_to_string(list_sort({O.swaps('phone')}), ',') as swaps from nu"""))
def phone_swaps(spark, d):
    u = Inputs.of(spark, d).t.users.select("user_id", K.norm_phone(F.col("phone")).alias("phone"))
    return u.select("user_id", F.array_join(F.array_sort(K.adjacent_swaps(F.col("phone"))), ",").alias("swaps"))


@query("deletion_keys", q(f"""select user_id, array_to_string(list_sort({O.dels('core')}), ',') as deletions from nu"""))
def deletion_keys(spark, d):
    u = L.normalise_users(Inputs.of(spark, d).t.users)
    return u.select("user_id", F.array_join(F.array_sort(K.deletions(F.col("core"))), ",").alias("deletions"))


@query("domain_fix", q(f"""select raw, {O.fix_dom('raw')} as fixed, count(*) as n from (
   select regexp_extract({O.text_of('buyer_email')}, '@([^@]*)$', 1) as raw from sales where contains(coalesce(buyer_email, ''), '@')) group by 1, 2"""))
def domain_fix(spark, d):
    s = Inputs.of(spark, d).t.sales.select(K.email_text(F.col("buyer_email")).alias("t")).filter(F.col("t").contains("@"))
    return s.groupBy(F.substring_index("t", "@", -1).alias("raw")).agg(F.count(F.lit(1)).alias("n")).select("raw", K.fix_domain(F.col("raw")).alias("fixed"), "n")


# ------------------------------------------------------------- linkage
@query("link_blocks", q(" union all ".join(f"""select '{k}' as kind, count(*) as n_keys, coalesce(sum(ns_n * nu_n), 0)::bigint as n_pairs, coalesce(max(nu_n), 0) as largest_user_block
   from (select {k} as k, count(*) as ns_n from ns where {k} <> '' group by 1) join (select {k} as k, count(*) as nu_n from nu where {k} <> '' group by 1) using (k)"""
   for k in ("email", "local", "core", "phone"))))
def link_blocks(spark, d):
    t = Inputs.of(spark, d).t
    return L.block_sizes(t.sales, t.users)


_STRONG = "select sale_id, user_id, e, p, n, score from evid where e >= 0.65 or p > 0"


@query("link_candidates", q(f"""select sale_id, count(*) as n_candidates, round(max(score), 6) as best_score, max(user_id) as max_user from ({_STRONG}) group by 1"""))
def link_candidates(spark, d):
    """Candidates that can decide: shared e-mail, identifying or near mailbox, or phone."""
    i = Inputs.of(spark, d)
    s = L.normalise_sales(i.t.sales)
    profiles, users = frozen(L.buyer_profiles(s)), frozen(L.user_profiles(L.normalise_users(i.t.users)))
    cfg = L.LinkConfig()
    strong = L.scored_strong(L.strong_pairs(profiles, users), cfg).filter((F.col("e") >= 0.65) | (F.col("p") > 0))
    pairs = strong.select("pid", "uid", "score").distinct()
    members = users.select("uid", "n_users")
    per = pairs.join(members, "uid").groupBy("pid").agg(
        F.sum("n_users").alias("n_candidates"), r(F.max("score")).alias("best_score"), F.max("uid").alias("max_user"))
    return s.select("sale_id", "pid").join(per, "pid").drop("pid")


_LINK = "sale_id, user_id, round(confidence, 4) as confidence, ev_email, ev_phone, ev_name, via"


@query("link_matches", q(f"select {_LINK} from links"))
def link_matches(spark, d):
    return Inputs.of(spark, d).links.select("sale_id", "user_id", r("confidence", 4).alias("confidence"), "ev_email", "ev_phone", "ev_name", "via")


@query("link_propagated", q("select sale_id, user_id, round(confidence, 4) as confidence from links where via = 'propagado'"))
def link_propagated(spark, d):
    return Inputs.of(spark, d).links.filter("via = 'propagado'").select("sale_id", "user_id", r("confidence", 4).alias("confidence"))


@query("link_coverage", q("""select count(*) as n_sales, count(user_id) as n_matched, round(count(user_id) / count(*), 6) as share_matched,
   count(*) filter (via = 'propagado') as n_propagated from links"""))
def link_coverage(spark, d):
    return L.coverage(Inputs.of(spark, d).links)


def _share(c):
    return f"round(avg(cast({c} as int)), 6)"


@query("link_evidence_audit", q(f"""select count(*) as n_direct, {_share('ev_email = 1')} as share_email, {_share('ev_phone = 1')} as share_phone,
   {_share('ev_email = 1 and ev_phone = 1')} as share_both, {_share('ev_email = 1 or ev_phone = 1')} as share_any, {_share('ev_name >= 0.9')} as share_name
   from links where via = 'directo'"""))
def link_evidence_audit(spark, d):
    return L.evidence_audit(Inputs.of(spark, d).links)


@query("key_quality", q(f"""select count(*) filter (has and raw not in {O.lst(O.KNOWN_DOMAINS)}) as sales_unknown_domain,
   count(*) filter (has and raw not in {O.lst(O.KNOWN_DOMAINS)} and dom in {O.lst(O.KNOWN_DOMAINS)}) as sales_repaired_domain,
   count(*) filter (phone = '') as sales_blank_phone,
   (select count(*) from (select array_to_string(list_sort({O.tokens_of("first_name || ' ' || last_name")}), ' ') as k, count(*) as c from users group by 1) where c > 1) as names_repeated,
   (select count(*) from (select array_to_string(list_sort({O.tokens_of("first_name || ' ' || last_name")}), ' ') as k, count(*) as c from users group by 1) where c > 3) as names_over_three
   from (select s.dom, s.phone, l.rawdom as raw, l.rawdom is not null as has from ns s join nsl l using (sale_id))"""))
def key_quality(spark, d):
    t = Inputs.of(spark, d).t
    return L.key_quality(t.sales, t.users)


@query("name_similarity", q("""select sale_id, round(n, 6) as similarity from evid e join (select s.sale_id, o.o_custkey as who from ns s join orders o on o.o_orderkey = s.sale_id) w using (sale_id)
   where e.user_id = who"""))
def name_similarity(spark, d):
    """Similarity of each sale's name to the user of the same customer key, where they are candidates."""
    i = Inputs.of(spark, d)
    s = frozen(L.normalise_sales(i.t.sales))
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("sale_id"), F.col("o_custkey").alias("user_id"))
    u = frozen(L.normalise_users(i.t.users))
    pairs = s.join(orders, "sale_id").join(u.select("user_id", F.col("names").alias("u_names"), F.col("email").alias("u_email"),
                                                    F.col("local").alias("u_local"), F.col("core").alias("u_core"), F.col("phone").alias("u_phone")), "user_id")
    around = lambda c: F.concat(F.array(c), K.deletions(F.col(c)))
    is_cand = (
        ((F.col("email") != "") & (F.col("email") == F.col("u_email")))
        | ((F.col("local") != "") & (F.col("local") == F.col("u_local")))
        | ((F.col("core") != "") & (F.col("u_core") != "") & F.arrays_overlap(around("core"), around("u_core")))
        | ((F.col("phone") != "") & ((F.col("phone") == F.col("u_phone")) | F.array_contains(K.adjacent_swaps(F.col("u_phone")), F.col("phone"))))
    )
    return pairs.filter(is_cand).select("sale_id", r(K.name_similarity(F.col("names"), F.col("u_names"))).alias("similarity"))


# ------------------------------------------------------------- history and features
_HCOLS = "n_minimum, u_minimum, round(rate_minimum, 6) as rate_minimum, n_membership, u_membership, round(rate_membership, 6) as rate_membership, n_history, round(rate_history, 6) as rate_history"


@query("history_asof", q(f"select user_id, strftime(cut, '%Y-%m-%d %H:%M:%S') as cut, {_HCOLS} from hist_then"))
def history_asof(spark, d):
    f = Inputs.of(spark, d).features.filter("linked").select("user_id", "cut")
    return rounded(H.as_of(f, Inputs.of(spark, d).t.history).withColumn("cut", F.date_format("cut", "yyyy-MM-dd HH:mm:ss")))


@query("history_global_cut", q(f"select user_id, {_HCOLS} from today"))
def history_global_cut(spark, d):
    return rounded(H.at_cut(Inputs.of(spark, d).t.history, AS_OF))


_FEAT = ["ticket_id", "sale_id", "event_id", "artist_id", "artist_name", "month", "ticket_type", "is_courtesy", "price", "channel", "qty", "lead_days",
         "linked", "user_id", "confidence", "n_history", "rate_history", "rate_minimum", "n_minimum", "rate_membership", "n_membership",
         "has_membership", "same_city", "y"]
_FLOATS = {"price", "lead_days", "confidence", "rate_history", "rate_minimum", "rate_membership"}


@query("ticket_features", q("select " + ", ".join(f"round({c}, 6) as {c}" if c in _FLOATS else c for c in _FEAT) + " from feat"))
def ticket_features(spark, d):
    return rounded(Inputs.of(spark, d).features.select(*_FEAT))


# ------------------------------------------------------------- designs
_CH = "cast(channel = 'BOX_OFFICE' as int)::double as ch_box, cast(channel = 'ADMIN' as int)::double as ch_admin, cast(channel = 'RRPP' as int)::double as ch_rrpp"
_LAST = "cast(coalesce(lead_days <= 1, false) as int)::double as last_day"


@query("m1_design_courtesy", q(f"""select ticket_id, cast(linked as int)::double as linked_f, cast(rate_minimum is not null as int)::double as has_rate,
   round(coalesce(rate_minimum - 0.75, 0.0), 6) as rate_c, round(ln(1 + n_history) / 3.0, 6) as log_n, cast(has_membership as int)::double as member,
   cast(same_city as int)::double as city_f, {_LAST}, {_CH} from feat where is_courtesy and labelled"""))
def m1_design_courtesy(spark, d):
    return rounded(M.design(Inputs.of(spark, d).features.filter("labelled"), "courtesy").select("ticket_id", *M.COURTESY_DESIGN))


@query("m1_design_paid", q(f"""select ticket_id, cast(ticket_type = 'Preferencial' as int)::double as preferred, cast(ticket_type = 'VIP' as int)::double as vip,
   {_LAST}, {_CH} from feat where not is_courtesy and labelled"""))
def m1_design_paid(spark, d):
    """Reads nothing of a buyer's history, so sales need no links."""
    return rounded(M.design(Inputs.of(spark, d).lab, "paid").select("ticket_id", *M.PAID_DESIGN))


_C = "cast(is_courtesy as int)"
_L99 = "cast(coalesce(lead_days, 99.0) <= 1 as int)"


@query("m2_interactions", q(f"""select ticket_id, round({_C} * coalesce(rate_minimum, 0.75), 6) as c_rate, ({_C} * cast(linked as int))::double as c_linked,
   round({_C} * ln(1 + n_history), 6) as c_log_n, ({_C} * cast(same_city as int))::double as c_city, ({_C} * cast(has_membership as int))::double as c_member,
   {_L99}::double as last_day, ({_C} * {_L99})::double as c_last_day from feat"""))
def m2_interactions(spark, d):
    return rounded(M.interactions(Inputs.of(spark, d).features).select("ticket_id", *M.DERIVED))


# ------------------------------------------------------------- evaluation
def _both(i: Inputs) -> DataFrame:
    keep = ["model", "ticket_id", "event_id", "is_courtesy", "is_residency", "y", "p"]
    return i.test3.select(*keep).unionByName(i.test2.select(*keep))


_T = "(select 'B3' as model, * from test3 union all by name select 'B2' as model, * from test2)"
_EV = f"select model, event_id, count(*) as n, sum(yn) as obs, sum(p) as pred, avg(cast(is_courtesy as int)) as courtesy_share from {_T} group by 1, 2"


@query("event_aggregate", q(f"select model, event_id, n, obs::bigint as obs, round(pred, 6) as pred, round(courtesy_share, 6) as courtesy_share from ({_EV})"))
def event_aggregate(spark, d):
    return rounded(E.by_event(_both(Inputs.of(spark, d))))


@query("event_metrics", q(f"""select model, round(avg(abs(pred - obs)), 6) as mae, round(avg(abs(pred - obs) / greatest(obs, 1)), 6) as mape,
   round(avg(pred - obs), 6) as bias, count(*) as n_events, round(quantile_cont(abs(pred - obs), 0.5), 6) as median_ae,
   round(quantile_cont(abs(pred - obs), 0.9), 6) as p90_ae from ({_EV}) group by 1"""))
def event_metrics(spark, d):
    return rounded(E.event_metrics(_both(Inputs.of(spark, d))))


_CLIP9 = "least(1 - 1e-9, greatest(1e-9, p))"


@query("ticket_metrics", q(f"""select model, round(avg(-(case when y then ln({_CLIP9}) else ln(1 - {_CLIP9}) end)), 6) as log_loss,
   round(avg(({_CLIP9} - yn) * ({_CLIP9} - yn)), 6) as brier from {_T} group by 1"""))
def ticket_metrics(spark, d):
    return rounded(E.loss_metrics(_both(Inputs.of(spark, d))))


_CAL = f"""select model, bin, avg(p) as mean_p, avg(yn) as observed, count(*) as n from (
   select *, ntile(10) over (partition by model order by p, ticket_id) as bin from {_T}) group by 1, 2"""


@query("calibration_table", q(f"select model, cast(bin as int) as bin, round(mean_p, 6) as mean_p, round(observed, 6) as observed, n from ({_CAL})"))
def calibration_table(spark, d):
    return rounded(E.calibration_table(_both(Inputs.of(spark, d))))


@query("ece", q(f"select model, round(sum(n * abs(mean_p - observed)) / sum(n), 6) as ece from ({_CAL}) group by 1"))
def ece(spark, d):
    return rounded(E.ece(_both(Inputs.of(spark, d))))


@query("ranking_metrics", q("""select model, round(sum(neg * (tp - pos + pos / 2.0)) / (any_value(np)::double * any_value(nn)), 6) as auc_roc,
   round(sum(pos * tp / (tp + fp)) / any_value(np), 6) as auc_pr from (
     select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by model) as np, sum(neg) over (partition by model) as nn
     from (select model, p, sum(yn) as pos, sum(1 - yn) as neg from """ + _T + """ group by 1, 2) window w as (partition by model order by p desc)) group by 1"""))
def ranking_metrics(spark, d):
    return rounded(E.ranking_metrics(_both(Inputs.of(spark, d))))


@query("error_by_segment", q(f"""select model, cut, value, count(*) as n, round(avg(err), 6) as mean_bias, round(avg(abs(err)), 6) as mean_abs_error from (
   select model, 'is_courtesy' as cut, is_courtesy as value, p - yn as err from {_T} union all select model, 'is_residency', is_residency, p - yn from {_T}) group by 1, 2, 3"""))
def error_by_segment(spark, d):
    return rounded(E.error_by_segment(_both(Inputs.of(spark, d)), ["is_courtesy", "is_residency"]))


_REPS = 4000


def _boot(value, src):
    n = "(select count(distinct event_id) from evs)"
    coef = ", ".join(f"{O.h31(SEED, repr('boot'), 'rep', repr(f'c{k}'))} as b{k}" for k in range(4))
    return dict(
        evs=src,
        ranks="select event_id, row_number() over (order by event_id) as pos from (select distinct event_id from evs)",
        draws=f"select rep, cast(floor({O.poly('b', 'i')} * {n}) as bigint) + 1 as pos from (select rep, {coef} from range({_REPS}) r(rep)), (select unnest(range({n})) as i)",
        means=f"select model, rep, avg({value}) as m from draws join ranks using (pos) join evs using (event_id) group by 1, 2",
    )


@query("bootstrap_mae", q("""select model, round((select avg(ae) from evs e where e.model = means.model), 6) as mae, round(quantile_cont(m, 0.025), 6) as ci_low,
   round(quantile_cont(m, 0.975), 6) as ci_high from means group by 1""", **_boot("ae", f"select *, abs(pred - obs) as ae from ({_EV})")))
def bootstrap_mae(spark, d):
    return rounded(E.bootstrap_mae(_both(Inputs.of(spark, d)), _REPS))


@query("paired_bootstrap", q("""select model, round((select avg(dif) from evs), 6) as mean_dif, round(quantile_cont(m, 0.025), 6) as ci_low,
   round(quantile_cont(m, 0.975), 6) as ci_high, round(quantile_cont(m, 0.025), 9) > 0 or round(quantile_cont(m, 0.975), 9) < 0 as conclusive from means group by 1""",
   **_boot("dif", f"""select a.model, a.event_id, abs(a.pred - a.obs) - abs(b.pred - b.obs) as dif from ({_EV}) a join ({_EV}) b
     on a.event_id = b.event_id and a.model = 'B3' and b.model = 'B2'""")))
def paired_bootstrap(spark, d):
    return rounded(E.paired_difference(_both(Inputs.of(spark, d)), "B2", _REPS))


# ------------------------------------------------------------- forecast
@query("expected_attendance", q("""select event_id, round(sum(p), 6) as expected, count(*) as n_tickets, round(avg(cast(is_courtesy as int)), 6) as courtesy_share
   from fut2 group by 1"""))
def expected_attendance(spark, d):
    """Expected attendance per upcoming show from the rate by ticket type."""
    i = Inputs.of(spark, d)
    p = R.TypeRate().fit(i.lab).predict(i.future)
    return rounded(p.groupBy("event_id").agg(F.sum("p").alias("expected"), F.count(F.lit(1)).alias("n_tickets"),
                                             F.avg(F.col("is_courtesy").cast("int")).alias("courtesy_share")))


@query("forecast_totals", q("""select count(*) as n_shows, sum(n_tickets)::bigint as n_tickets, sum(expected_attendance)::bigint as expected_attendance,
   round(sum(expected_attendance) / sum(n_tickets), 4) as rate, round(sum(n_courtesy) / sum(n_tickets), 4) as courtesy_share from fc3"""))
def forecast_totals(spark, d):
    return rounded(RP.totals(S.forecast_facts(Inputs.of(spark, d).fut3)), 4)


@query("show_shock", q("""select round(intercept, 6) as intercept, round(slope, 6) as slope, round(floor, 6) as floor, round(sigma_single, 6) as sigma_single, n_events from shock"""))
def show_shock(spark, d):
    return rounded(Inputs.of(spark, d).shock)


_NS, _NS_BACK = 20_000, 4_000


def _counts(src, sig, n=_NS):
    """Raw simulated counts of `src` tickets under `sig` sigmas, a binomial number for each cell of equal tickets."""
    z = f"lp + sigma * {O.normal('s', 'v', 'eh')}"
    return dict(
        simc=O.sims(n, "tsv"),
        equal=f"select event_id, max(p) as p, count(*) as n, {O.h31(repr('cell'), 'min(ticket_id)')} as h from {src} group by event_id, round(p, 12)",
        keyed=f"""select event_id, n, {O.logit('p')} as lp, h, sigma, {O.h31(repr('show'), 'event_id')} as eh
            from equal join (select event_id, sigma from {sig}) using (event_id)""",
        chances=f"select event_id, sim, n, {O.sigmoid(z)} as pp, {O.poly('t', 'h')} as u from keyed, simc",
        begun="select *, sqrt(n * pp * (1 - pp)) as sd, greatest(0, floor(n * pp - 8 * sqrt(n * pp * (1 - pp)) - 8)) as k0 from chances",
        counts=f"select event_id, sim, sum({O.binomial('u', 'n', 'pp', 'k0', 'sd')}) as cnt from begun group by 1, 2",
    )


def _tossed(src, sig, n=_NS):
    """As `_counts`, by a draw for each ticket in each simulation."""
    z = f"lp + sigma * {O.normal('s', 'v', 'eh')}"
    return dict(
        simc=O.sims(n, "tsv"),
        keyed=f"""select event_id, {O.logit('p')} as lp, {O.h31('ticket_id')} as h, sigma, {O.h31(repr('show'), 'event_id')} as eh
            from {src} join (select event_id, sigma from {sig}) using (event_id)""",
        counts=f"select event_id, sim, sum(cast({O.poly('t', 'h')} < {O.sigmoid(z)} as int)) as cnt from keyed, simc group by 1, 2",
    )


_IV = """select c.event_id, any_value(x.n) as n, any_value(x.expected) as expected, quantile_cont(cnt, 0.1) - avg(cnt) + any_value(x.expected) as p10,
   quantile_cont(cnt, 0.9) - avg(cnt) + any_value(x.expected) as p90 from counts c join (select event_id, count(*) as n, sum(p) as expected from {src} group by 1) x
   on x.event_id = c.event_id group by 1"""


@query("simulate_attendance", q("select event_id, sim, cnt::bigint as cnt from counts", **_tossed("fut3", "sig_fut")))
def simulate_attendance(spark, d):
    i = Inputs.of(spark, d)
    return S.count_entries(i.fut3, S.show_sigmas(i.fut3, i.shock), _NS, each=True)


@query("forecast_interval", q(f"select event_id, n, round(expected, 6) as expected, round(p10, 6) as p10, round(p90, 6) as p90 from ({_IV.format(src='fut3')})", **_tossed("fut3", "sig_fut")))
def forecast_interval(spark, d):
    i = Inputs.of(spark, d)
    return rounded(S.intervals(i.fut3, S.show_sigmas(i.fut3, i.shock), _NS, each=True))


_TESTED = f"""select i.*, f.obs, f.courtesy_share, f.obs between p10 and p90 as inside, p90 - p10 as width,
   case when courtesy_share > -0.01 and courtesy_share <= 0.25 then 'few courtesies' when courtesy_share > 0.25 and courtesy_share <= 0.6 then 'mixed'
     when courtesy_share > 0.6 and courtesy_share <= 1.01 then 'many courtesies' end as band
   from ({_IV.format(src='past3')}) i join ev3 f on f.event_id = i.event_id"""


@query("coverage_by_band", q("""select coalesce(band, 'all') as band, count(*) as n_events, round(avg(cast(inside as int)), 6) as coverage, round(avg(width), 6) as width
   from tested group by rollup (band)""", tested=_TESTED, **_counts("past3", "sig_past", _NS_BACK)))
def coverage_by_band(spark, d):
    i = Inputs.of(spark, d)
    return rounded(S.coverage_by_band(S.back_test(i.past3, i.shock, _NS_BACK)))


_W = "round(avg(cast(obs between lo and hi as int)), 6) as coverage, round(avg(hi - lo), 6) as width, round(avg(hi - lo + 10.0 * (greatest(lo - obs, 0) + greatest(obs - hi, 0))), 6) as winkler, count(*) as n"


@query("winkler", q(f"""select kind, {_W} from (select 'simulated' as kind, p10 as lo, p90 as hi, obs from tested union all select 'zero_to_sold', 0, n, obs from tested
   union all select 'half', expected * 0.5, expected * 1.5, obs from tested union all select 'fifth', expected * 0.8, expected * 1.2, obs from tested) group by 1""",
   tested=_TESTED, **_tossed("past3", "sig_past", _NS_BACK)))
def winkler(spark, d):
    i = Inputs.of(spark, d)
    return rounded(E.interval_scores(S.interval_kinds(S.back_test(i.past3, i.shock, _NS_BACK, each=True))))


@query("zero_show_rate", q("""select count(*) as n_sales, round(avg(cast(any_in = 0 as int)), 6) as observed_zero, round(avg(exp(log_none)), 6) as independent_zero
   from (select sale_id, count(*) as n, max(yn) as any_in, sum(ln(1 - p)) as log_none from past3 group by 1) where n >= 2"""))
def zero_show_rate(spark, d):
    return rounded(S.zero_show_rate(Inputs.of(spark, d).past3))


_GRID = [0.25 * i for i in range(13)]


@query("group_shock", q("""select sigma::double as sigma, round(zero_rate, 6) as zero_rate, round(abs(zero_rate - (select avg(cast(any_in = 0 as int)) from sales_p)), 6) as gap from (
   select sigma, sum(none * weight) / sum(weight) as zero_rate from (select sale_id, sigma, sum(none * w) as none from per_node group by 1, 2) join classes using (sale_id) group by 1)""",
   sales_p="select sale_id, max(yn) as any_in, list_sort(list(p)) as ps from past3 group by 1 having count(*) >= 2",
   classes="select min(sale_id) as sale_id, count(*) as weight from sales_p group by ps",
   nodes="select z, exp(-z * z / 2) / sum(exp(-z * z / 2)) over () as w from (select unnest(range(-136, 137)) * 0.0625::double as z)",
   members=f"select sale_id, {O.logit('p')} as lp from past3 where sale_id in (select sale_id from classes)",
   per_node=f"""select sale_id, sigma, z, any_value(w) as w, exp(sum(ln(1 - {O.sigmoid('lp + sigma * z')}))) as none
       from members, nodes, (select unnest({_GRID}) as sigma) group by 1, 2, 3"""))
def group_shock(spark, d):
    return rounded(S.group_shock(Inputs.of(spark, d).past3, _GRID))


# ------------------------------------------------------------- decisions
@query("invite_candidates", q("select event_id, user_id, round(p, 6) as p, place, round(cum, 6) as cum from invited"))
def invite_candidates(spark, d):
    return rounded(Inputs.of(spark, d).chosen.select("event_id", "user_id", "p", "place", "cum"))


_LEV = "event_id, lever, strength, round(impact, 6) as impact, reach"


@query("invite_lever", q(f"select {_LEV}, round(mean_p, 6) as mean_p, days_margin from l_invite"))
def invite_lever(spark, d):
    return rounded(Inputs.of(spark, d).invite)


@query("channel_lever", q(f"select {_LEV} from l_channel"))
def channel_lever(spark, d):
    i = Inputs.of(spark, d)
    return rounded(D.channel_lever(i.future, i.seats, i.lab))


@query("convert_lever", q(f"select {_LEV} from l_convert"))
def convert_lever(spark, d):
    i = Inputs.of(spark, d)
    return rounded(D.convert_lever(i.future, i.seats, i.lab))


@query("actions", q("select event_id, artist_name, expected_attendance, capacity, free, cast(place as int) as place, lever, strength, impact, reach from acts"))
def actions(spark, d):
    return Inputs.of(spark, d).actions


@query("top_invites", q("""select event_id, artist_name, expected_attendance, capacity, free, cast(place as int) as place, lever, strength, impact, reach from acts
   where lever = 'invitar' order by impact desc, event_id limit 5"""))
def top_invites(spark, d):
    return D.top_invites(Inputs.of(spark, d).actions)


def _over(i: Inputs):
    return i.once("over", lambda: frozen(D.overbooking(i.fut3, S.show_sigmas(i.fut3, i.shock), i.t.events)))


@query("overbooking")
def overbooking(spark, d):
    """At 6,000 simulations and 4,000 extra tickets; too much for SQL, tests hold it against brute force."""
    return rounded(_over(Inputs.of(spark, d)).drop("courtesy_share"))


@query("top_overbooking")
def top_overbooking(spark, d):
    return D.top_overbooking(rounded(_over(Inputs.of(spark, d)).drop("courtesy_share")))


# ------------------------------------------------------------- arrival, door, report
@query("arrival_curve", q("select minute, n, round(fraction, 6) as fraction from curve"))
def arrival_curve(spark, d):
    return rounded(Inputs.of(spark, d).curve)


@query("arrival_profile", q("select event_id, minute, label, round(fraction, 6) as fraction, round(people, 6) as people, round(running, 6) as running from prof"))
def arrival_profile(spark, d):
    i = Inputs.of(spark, d)
    return rounded(A.arrival_profile(S.forecast_facts(i.fut3), i.curve))


@query("door_staffing", q("select event_id, round(peak, 6) as peak, peak_label, peak_minute, staff from peak"))
def door_staffing(spark, d):
    i = Inputs.of(spark, d)
    return rounded(A.door_staffing(S.forecast_facts(i.fut3), i.curve))


_NOW = f"timestamp '{NOW}'"


@query("door_sheet", q(f"""select f.event_id, s.title, f.artist_name, s.venue, strftime(s.starts_at, '%Y-%m-%d %H:%M') as starts_at,
   strftime(s.starts_at - interval 6 hour, '%Y-%m-%d %H:%M') as opens_at, strftime(s.starts_at + interval 3 hour, '%Y-%m-%d %H:%M') as expires_at,
   case when {_NOW} < s.starts_at - interval 6 hour then 'BEFORE' when {_NOW} < s.starts_at + interval 3 hour then 'DOOR' else 'EXPIRED' end as state,
   f.expected_attendance, f.n_tickets, f.courtesy_share, k.staff, round(k.peak, 6) as peak, k.peak_label,
   case when f.courtesy_share >= 0.5 then 'mix' when {_NOW} < s.starts_at - interval 6 hour
     then cast(greatest(0, cast(floor((epoch_us(s.starts_at) - epoch_us({_NOW})) / 86400e6::double) as bigint)) as varchar) || ' days left' else '' end as warning
   from fc3 f join shows s on s.event_id = f.event_id join peak k on k.event_id = f.event_id"""))
def door_sheet(spark, d):
    i = Inputs.of(spark, d)
    fc = S.forecast_facts(i.fut3).withColumns({"p10": F.lit(0), "p90": F.lit(0)})
    sheet = A.door_sheet(fc, i.t.events, i.curve, NOW).drop("p10", "p90", "city")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return rounded(sheet).select(*[fmt(c) if c in ("starts_at", "opens_at", "expires_at") else F.col(c) for c in sheet.columns])


def _shows(i: Inputs) -> DataFrame:
    fc = S.forecast_facts(i.fut3).withColumns({"p10": F.lit(None).cast("int"), "p90": F.lit(None).cast("int")})
    return RP.show_rows(fc, i.t.events, i.actions)


_SHOW = """select f.event_id, s.title, f.artist_name, strftime(s.starts_at, '%Y-%m-%d %H:%M') as starts_at, s.capacity, f.expected_attendance,
   case when s.capacity > 0 then round_even(f.expected_attendance / s.capacity, 4) end as fill_rate,
   case when s.capacity > 0 then greatest(0, s.capacity - f.expected_attendance) end as free_seats, s.starts_at as k
   from fc3 f join shows s on s.event_id = f.event_id"""
_SHOWC = ["event_id", "title", "artist_name", "capacity", "expected_attendance", "fill_rate", "free_seats"]


@query("agenda", q(f"select * exclude (k), row_number() over (order by k, event_id) as place from ({_SHOW})"))
def agenda(spark, d):
    """Shows in date order; the place column lets an unordered comparison see the order."""
    from turnout.operators.ordered import running

    shows = _shows(Inputs.of(spark, d)).select(*_SHOWC, "starts_at")
    placed = running(RP.agenda(shows), [F.col("starts_at"), F.col("event_id")], rank="place")
    return placed.select("event_id", "title", "artist_name", F.date_format("starts_at", "yyyy-MM-dd HH:mm").alias("starts_at"),
                         "capacity", "expected_attendance", "fill_rate", "free_seats", "place")


@query("emptiest", q(f"select {', '.join(_SHOWC)} from ({_SHOW}) where fill_rate is not null order by fill_rate, event_id limit 5"))
def emptiest(spark, d):
    return RP.emptiest(_shows(Inputs.of(spark, d)).select(*_SHOWC))


@query("show_lookup", q(f"""select asked, s.event_id, s.artist_name, case when s.event_id is null then 'unknown' when s.starts_at > {O.TS} then 'upcoming' else 'past' end as status
   from (select n_name as asked from nation union all select distinct artist_name from shows union all select cast(s_suppkey as varchar) from supplier) a
   left join shows s on lower(s.artist_name) = lower(asked) or cast(s.event_id as varchar) = asked"""))
def show_lookup(spark, d):
    t = Inputs.of(spark, d).t
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("asked"))
    asked = nations.unionByName(t.events.select(F.col("artist_name").alias("asked")).distinct()).unionByName(
        t.events.select(F.col("event_id").cast("string").alias("asked")))
    return RP.show_lookup(asked, t.events, AS_OF)


@query("report_shows", q("""select a.event_id, array_to_string(list(lever || ':' || strength || ':' || format('{:.1f}', impact) || ':' || reach order by place), ' ') as levers,
   any_value(expected_attendance) as expected_attendance, any_value(case when capacity > 0 then free end) as free_seats from acts a group by 1"""))
def report_shows(spark, d):
    """The nested show documents, parsed back and flattened."""
    docs = RP.show_documents(_shows(Inputs.of(spark, d)))
    s = docs.select("event_id", F.from_json("doc", "esperado INT, asientos_libres INT, palancas ARRAY<STRUCT<palanca STRING, supuesto STRING, impacto_personas DOUBLE, alcance BIGINT>>").alias("j"))
    lever = lambda x: F.concat_ws(":", x["palanca"], x["supuesto"], F.format_string("%.1f", x["impacto_personas"]), x["alcance"].cast("string"))
    return s.select("event_id", F.array_join(F.transform("j.palancas", lever), " ").alias("levers"),
                    F.col("j.esperado").alias("expected_attendance"), F.col("j.asientos_libres").alias("free_seats"))


def _season(i: Inputs) -> DataFrame:
    def make():
        fc = S.forecast_facts(i.fut3).withColumns({"p10": F.lit(None).cast("int"), "p90": F.lit(None).cast("int")})
        return frozen(RP.season_document(_shows(i), fc, _over(i), i.curve, '{"campeon": "M1"}', AS_OF))

    return i.once("season", make)


@query("report_summary", q("""select count(*) as shows, sum(n_tickets)::bigint as tickets, sum(expected_attendance)::bigint as expected, count(*)::bigint as n_docs,
   (select count(*) from curve) as n_bins from fc3"""))
def report_summary(spark, d):
    """Counts read back from the single season document."""
    i = Inputs.of(spark, d)
    doc = _season(i)
    j = F.from_json("doc", """resumen STRUCT<shows BIGINT, entradas_adquiridas BIGINT, asistencia_esperada BIGINT>,
        shows ARRAY<STRUCT<event_id BIGINT>>, curva_llegada STRUCT<fracciones MAP<STRING, DOUBLE>>""")
    x = doc.select(j.alias("j"))
    return x.select(F.col("j.resumen.shows").alias("shows"), F.col("j.resumen.entradas_adquiridas").alias("tickets"),
                    F.col("j.resumen.asistencia_esperada").alias("expected"), F.size("j.shows").cast("bigint").alias("n_docs"),
                    F.size("j.curva_llegada.fracciones").cast("bigint").alias("n_bins"))


@query("report_freshness", q(f"""select event_id, cast(floor((epoch_us(starts_at) - epoch_us({O.TS})) / 86400e6::double) as bigint) as age_days,
   floor((epoch_us(starts_at) - epoch_us({O.TS})) / 86400e6::double) > 7 as stale from shows where starts_at > {O.TS}"""))
def report_freshness(spark, d):
    """How old the season document is when each upcoming show starts; its date is read back from the document."""
    i = Inputs.of(spark, d)
    made = F.from_json("doc", "generado STRING")["generado"].cast("timestamp")
    generated = _season(i).select(made.alias("at")).scalar()
    upcoming = i.t.events.filter(F.col("starts_at").cast("timestamp") > F.lit(AS_OF).cast("timestamp"))
    return upcoming.select("event_id", RP.freshness(generated, F.col("starts_at").cast("timestamp")).alias("f")).select("event_id", "f.age_days", "f.stale")


_CARD = [("mae", "avg(abs(pred - obs))"), ("mape", "avg(abs(pred - obs) / greatest(obs, 1))"), ("bias", "avg(pred - obs)"), ("n_events", "count(*)::double"),
         ("median_ae", "quantile_cont(abs(pred - obs), 0.5)"), ("p90_ae", "quantile_cont(abs(pred - obs), 0.9)")]


@query("model_card", q(" union all ".join(f"select 'B2' as champion, 'test' as stage, model, '{m}' as metric, round({e}, 6) as value from ({_EV}) group by model" for m, e in _CARD)))
def model_card(spark, d):
    """The metrics document of a comparison, written as JSON and read back."""
    metrics = E.event_metrics(_both(Inputs.of(spark, d)))
    return rounded(RP.read_card(RP.model_card(X.facts(metrics, "test"), "B2")))


@query("experiment_card")
def experiment_card(spark, d):
    """The metrics document of the whole experiment, all eight models, read back."""
    return rounded(RP.read_card(RP.model_card(_experiment(Inputs.of(spark, d)), X.CHAMPION)))


_PERM = 1000


_PERMUTED = dict(
   pbase="select ticket_id, rate_minimum as r, yn from feat where labelled and is_courtesy and rate_minimum is not null",
   preps="select rep, " + ", ".join(f"{O.h31(SEED, 'rep', repr(f'c{k}'))} as c{k}" for k in range(4)) + f" from range(1, {_PERM + 1}) x(rep)",
   shuf=f"select rep, yn, row_number() over (partition by rep order by u, ticket_id) as k from (select rep, ticket_id, yn, {O.poly('c', 'h')} as u from (select *, {O.h31('ticket_id')} as h from pbase), preps)",
   fixed="select r, row_number() over (order by ticket_id) as k from pbase",
   every="select rep, yn, r from shuf join fixed using (k) union all select 0, yn, r from pbase",
   gaps="select rep, avg(yn) filter (r > 0.7) - avg(yn) filter (r <= 0.4) as gap from every group by 1",
)


def _gaps(i):
    courtesies = i.features.filter("is_courtesy and labelled")
    return i.once("gaps", lambda: frozen(L.permutation_gap(courtesies, "y", "rate_minimum", _PERM, SEED, 0.4, 0.7)))


@query("linkage_permutation", q("select rep, round(gap, 9) as gap from gaps", **_PERMUTED))
def linkage_permutation(spark, d):
    return _gaps(Inputs.of(spark, d))


@query("linkage_p_value", q("""select round(o.gap, 6) as gap, count(*) as reps, round((count(*) filter (round(abs(g.gap), 9) >= round(abs(o.gap), 9)) + 1) / (count(*) + 1)::double, 6) as p_value
   from gaps g, (select gap from gaps where rep = 0) o where g.rep > 0 group by o.gap""", **_PERMUTED))
def linkage_p_value(spark, d):
    return rounded(L.permutation_p(_gaps(Inputs.of(spark, d))))


# ------------------------------------------------------------- fitted models (rows only)
@query("m1_scores")
def m1_scores(spark, d):
    f = Inputs.of(spark, d).features
    m = M.SegmentedLogistic().fit(f.filter("labelled"))
    return m.predict(f.filter("not labelled")).select("ticket_id", "event_id", "p")


@query("m1_coefficients")
def m1_coefficients(spark, d):
    return M.SegmentedLogistic().fit(Inputs.of(spark, d).features.filter("labelled")).coefficients(spark)


_TERMS = " union all ".join(f"select '{seg}' as segment, unnest(['intercept', {', '.join(repr(c) for c in cols)}]) as term" for seg, cols in M.SEGMENTS.items())


@query("m1_optimality", q(f"""select segment, term, true as optimal from ({_TERMS} union all
   select distinct case when is_courtesy then 'courtesy' else 'paid' end, 'art:' || artist_id from feat where labelled)"""))
def m1_optimality(spark, d):
    """Whether the slope of the penalised likelihood vanishes at each weight of the real fit."""
    past = Inputs.of(spark, d).features.filter("labelled")
    return M.SegmentedLogistic().fit(past).slopes(past).select("segment", "term", (F.abs("slope") < 2e-4 * F.col("n") + 0.05).alias("optimal"))


def _dev_test(i):
    f = SP.temporal_split(i.features, WEEKS)
    return f.filter("split <> 'test'").drop("split"), f.filter("split = 'test'").drop("split")


@query("m2_scores")
def m2_scores(spark, d):
    dev, test = _dev_test(Inputs.of(spark, d))
    return M.InteractionLogistic().fit(dev).predict(test).select("ticket_id", "event_id", "y", "p")


@query("m3_scores")
def m3_scores(spark, d):
    dev, test = _dev_test(Inputs.of(spark, d))
    return M.BoostedTrees().fit(dev).predict(test).select("ticket_id", "event_id", "y", "p")


@query("m4_scores")
def m4_scores(spark, d):
    dev, test = _dev_test(Inputs.of(spark, d))
    return M.Forest().fit(dev).predict(test).select("ticket_id", "event_id", "y", "p")


@query("loo_residuals")
def loo_residuals(spark, d):
    return S.event_residuals(Inputs.of(spark, d).m1_held_out)


CV_MODELS = X.ALL_MODELS

_CLIP = "least(0.999999::double, greatest(0.000001::double, {}))"
_HELD = dict(
    fold_of=f"select event_id, ntile(5) over (order by {O.h31(SEED, 'event_id')}, event_id) as fold from (select distinct event_id from dev)",
    dv="select ticket_id, event_id, artist_id, ticket_type, is_courtesy, is_residency, yn, fold from dev join fold_of using (event_id)",
    fit="select f.fold, artist_id, ticket_type, count(*) as n, sum(yn) as o from dv, (select distinct fold from dv) f where dv.fold <> f.fold group by 1, 2, 3",
    f_all="select fold, sum(o)::double / sum(n) as r0 from fit group by 1",
    f_type="select fold, ticket_type, sum(o)::double / sum(n) as r from fit group by 1, 2",
    f_art="select fold, artist_id, (sum(o) + 60.0) / (sum(n * r) + 60.0) as f from fit join f_type using (fold, ticket_type) group by 1, 2",
    held=f"""select m.model, x.*, case m.model when 'B0' then 1.0 when 'B1' then r0 when 'B2' then coalesce(r, r0) else {_CLIP.format("coalesce(r, r0) * coalesce(f, 1.0)")} end as p
      from dv x join f_all using (fold) left join f_type using (fold, ticket_type) left join f_art using (fold, artist_id), (select unnest(['B0', 'B1', 'B2', 'B3']) as model) m""",
)


@query("oof_baselines", q("select model, cast(fold as int) as fold, ticket_id, round(p, 9) as p from held", **_HELD))
def oof_baselines(spark, d):
    """Out-of-fold predictions of the rate models, whole shows left out together."""
    i = Inputs.of(spark, d)
    out = i.once("oof_base", lambda: M.out_of_fold(R.BASELINES, SP.with_split(i.base, WEEKS).filter("split in ('train', 'val')")))
    return rounded(out.select("model", "fold", "ticket_id", "p"), 9)


def _oof(i):
    return i.once("oof", lambda: frozen(M.out_of_fold(CV_MODELS, _dev_test(i)[0])))


@query("oof_predictions")
def oof_predictions(spark, d):
    return _oof(Inputs.of(spark, d)).select("model", "fold", "ticket_id", "event_id", "y", "p")


@query("cv_table")
def cv_table(spark, d):
    return E.cv_table(_oof(Inputs.of(spark, d)), _REPS)


def _experiment(i: Inputs) -> DataFrame:
    dev, test = _dev_test(i)
    return i.once("experiment", lambda: frozen(X.run(dev, test, oof=_oof(i), reps=_REPS)))


@query("experiment")
def experiment(spark, d):
    """Protocol: cross-validate, compare with the best baseline, refit, test once."""
    return _experiment(Inputs.of(spark, d))
