"""Contract of the registered queries and the end-to-end run."""

import json
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows
from turnout.plans.pipeline import Settings, deliver, run_season
from turnout.sources.adapter import AS_OF
from turnout.sources.tables import read_json, require_no_dangling

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_oracle_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, res.fetchall())


@pytest.mark.parametrize("name", ["m1_scores", "m1_coefficients", "loo_residuals"])
def test_fitted_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_pipeline_end_to_end(spark, inputs, tmp_path):
    s = Settings(as_of=AS_OF, n_sim=200, n_sim_back_test=50, n_sim_overbooking=100, max_extra=300)
    season = run_season(inputs.t, s)
    f = season.forecast.toPandas()
    assert len(f) == 3 and ((f.p10 <= f.expected_attendance) & (f.expected_attendance <= f.p90)).all()
    assert season.actions.count() == 9 and season.overbooking.count() == 3
    deliver(season, inputs.t, str(tmp_path), AS_OF, '{"campeon": "M1"}')
    doc = json.loads(spark.read.text(os.path.join(tmp_path, "report")).first()[0])
    assert doc["resumen"]["shows"] == 3 and len(doc["shows"]) == 3 and len(doc["shows"][0]["palancas"]) == 3
    assert doc["modelo"]["campeon"] == "M1" and len(doc["sobreventa"]) == 3
    head = spark.read.csv(os.path.join(tmp_path, "forecast_detail"), header=True)
    assert head.columns[:4] == ["event_id", "expected_attendance", "p10", "p90"]


def test_json_scan_and_dangling_keys(spark, inputs, tmp_path):
    path = tmp_path / "events.json"
    path.write_text('[{"evt": "e1", "starts_at": "2026-08-08T20:00:00-05:00", "capacity": 10}, {"evt": "e2", "starts_at": null}]')
    got = {r["event_id"]: r for r in read_json(spark, "events", str(path), {"event_id": "evt"}).collect()}
    assert got["e1"]["starts_at"].hour == 1 and got["e2"]["capacity"] is None
    broken = type(inputs.t)(inputs.t.users, inputs.t.history, inputs.t.events.filter("event_id > 0"), inputs.t.sales, inputs.t.tickets)
    with pytest.raises(ValueError, match="event_id"):
        require_no_dangling(broken)
