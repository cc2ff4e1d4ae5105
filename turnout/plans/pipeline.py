"""The whole run: link, features, model, forecast, levers, over-selling, report."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.operators import arrival, decide, linkage, models, simulate
from turnout.operators.features import ticket_features
from turnout.plans import report
from turnout.session import frozen, scratch, stored
from turnout.sources.tables import Tables, require_no_dangling, write_csv, write_json_document

# Column names of the deliverables, in order.
FORECAST_COLUMNS = {"event_id": "event_id", "expected_attendance": "expected_attendance", "p10": "p10", "p90": "p90"}
DETAIL_COLUMNS = FORECAST_COLUMNS | {
    "artist_name": "artist_name", "tickets_adquiridos": "n_tickets", "cortesias": "n_courtesy",
    "pct_cortesia": "courtesy_share", "compradores_enlazados": "n_linked", "tasa_esperada": "expected_rate",
}
ACTION_COLUMNS = {
    "event_id": "event_id", "artista": "artist_name", "esperado": "expected_attendance", "capacidad": "capacity",
    "asientos_libres": "free", "palanca": "lever", "supuesto": "strength", "impacto_personas": "impact", "alcance": "reach",
}
OVERBOOKING_COLUMNS = {
    "event_id": "event_id", "artista": "artist_name", "capacidad": "capacity", "entradas_vendidas": "n_tickets",
    "esperado": "expected_attendance", "pct_cortesia": "courtesy_share", "puede_vender_mas": "extra",
    "riesgo_actual_desborde": "risk_now",
}


@dataclass
class Settings:
    as_of: str
    n_sim: int = 20000
    n_sim_back_test: int = 4000
    n_sim_overbooking: int = 6000
    max_extra: int = 4000
    seed: int = 20260801


@dataclass
class Season:
    links: DataFrame
    features: DataFrame
    model: models.SegmentedLogistic
    shock: DataFrame
    sigma_group: float
    scored_past: DataFrame
    scored_future: DataFrame
    forecast: DataFrame
    actions: DataFrame
    overbooking: DataFrame
    curve: DataFrame
    back_test: DataFrame


def run_season(t: Tables, s: Settings, check_keys: bool = True) -> Season:
    if check_keys:
        require_no_dangling(t)
    links = linkage.link(t.sales, t.users)
    with scratch(links.sparkSession):
        features = stored(ticket_features(t, links, s.as_of), keep=True)
    past, future = features.filter(F.col("y").isNotNull()), features.filter(F.col("y").isNull())

    held_out = stored(models.leave_show_out(past))
    shock = frozen(simulate.show_shock(simulate.event_residuals(held_out)))
    tested = frozen(simulate.back_test(held_out, shock, s.n_sim_back_test, s.seed))
    model = models.SegmentedLogistic().fit(past)
    scored_past = model.predict(past)
    sigma_group = simulate.chosen_group_sigma(scored_past)

    scored = stored(model.predict(future))
    sigmas = frozen(simulate.show_sigmas(scored, shock))
    forecast = frozen(simulate.forecast(scored, sigmas, s.n_sim, s.seed, sigma_group))

    shows = decide.seats(forecast, t.events)
    eligible = frozen(decide.eligible_users(t.users, t.history, s.as_of))

    def score(pairs: DataFrame) -> DataFrame:
        rows = decide.hypothetical_tickets(pairs, t.events, eligible, s.as_of)
        return model.predict(rows).select("event_id", "user_id", "p").join(pairs, ["event_id", "user_id"])

    chosen = decide.invite_candidates(
        eligible, shows.join(t.events.select("event_id", "city"), "event_id"),
        decide.holders(future), score, reads=model.user_columns,
    )
    acts = frozen(decide.actions(
        decide.invite_lever(chosen, shows, t.events, s.as_of),
        decide.channel_lever(future, shows, past), decide.convert_lever(future, shows, past), shows,
    ))
    over = frozen(decide.overbooking(scored, sigmas, t.events, s.n_sim_overbooking, max_extra=s.max_extra, seed=s.seed))
    curve = frozen(arrival.arrival_curve(t.tickets, t.events))
    return Season(links, features, model, shock, sigma_group, held_out, scored, forecast, acts, over, curve, tested)


def deliver(season: Season, t: Tables, folder: str, generated_at: str, model_card: str = "{}") -> None:
    """Write the CSV and JSON deliverables under `folder`."""
    out = lambda name: os.path.join(folder, name)
    links = season.links.withColumn("user", F.coalesce(F.col("user_id").cast("string"), F.lit("")))
    write_csv(links, out("matches"), {"sale_id": "sale_id", "user_id": "user", "confidence": "confidence"})
    write_csv(links, out("matches_detail"), {
        "sale_id": "sale_id", "user_id": "user", "confidence": "confidence", "ev_email": "ev_email",
        "ev_phone": "ev_phone", "ev_nombre": "ev_name", "via": "via"})
    write_csv(season.forecast, out("forecast"), FORECAST_COLUMNS)
    write_csv(season.forecast, out("forecast_detail"), DETAIL_COLUMNS)
    write_csv(season.actions, out("actions"), ACTION_COLUMNS)
    write_csv(season.overbooking, out("overbooking"), OVERBOOKING_COLUMNS)
    shows = report.show_rows(season.forecast, t.events, season.actions)
    write_json_document(
        report.season_document(shows, season.forecast, season.overbooking, season.curve, model_card, generated_at),
        out("report"),
    )
    write_json_document(report.show_documents(shows).select("doc"), out("report_shows"))
