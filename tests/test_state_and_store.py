"""Forecasts from a bounded state, chains of refits, the model store and cross-validation, against plain versions."""

import datetime
from datetime import date as D

import pytest
from pyspark.sql import functions as F

from tests.test_core import K, days, hourly, series
from wattloom import fixtures as X
from wattloom.operators import forecast as FC
from wattloom.operators import models as ML
from wattloom.operators import profiles as H
from wattloom.operators.metrics import error_metrics


@pytest.fixture(scope="module")
def weather(spark):
    return spark.createDataFrame([("a", D(2020, 1, 1), 20.0, 16.0, 28.0, 70.0, 2.0, 0.0, 0.0)], "UCP string, FECHA date, temp_mean double, temp_min double, temp_max double, humidity_mean double, wind_speed_mean double, rain_mean double, rain_sum double")


def rebuilt(history, weather, holidays, n, score):
    """Each step over the whole history and the forecasts so far."""
    real = seen = history.select("UCP", "FECHA", "TOTAL")
    fixed = FC.serving_features(real, weather, holidays, K, 1).select("UCP", *[c for c in FC.anchored_rolling(real, K).columns if c != "UCP"])
    past = FC.holiday_flags(real.select("UCP", "FECHA"), holidays, K)
    out = {}
    for _ in range(n):
        step = FC.serving_features(seen, weather, holidays, K, 1).drop(*[c for c in fixed.columns if c != "UCP"]).join(fixed, "UCP")
        step = FC.days_since_holiday(step.drop("days_since_holiday"), past, K)
        rows = FC.adjust(score(step)).select("UCP", "FECHA", "demanda_predicha").collect()
        out |= {(r["UCP"], r["FECHA"]): r["demanda_predicha"] for r in rows}
        seen = seen.unionByName(seen.sparkSession.createDataFrame([(r["UCP"], r["FECHA"], r["demanda_predicha"]) for r in rows], "UCP string, FECHA date, TOTAL double"))
    return out


def test_recursive_forecast_equals_a_rebuild_of_everything(spark, weather):
    """Two keys that end on different days, gaps, and 1 May inside the horizon."""
    a = series(spark, days(D(2019, 4, 1), [None if k % 50 == 3 else 100.0 + 7 * (k % 7) + k / 10 for k in range(394)]))
    b = series(spark, days(D(2020, 3, 1), [50.0 + k % 5 for k in range(40)])).where(F.dayofmonth("FECHA") % 6 != 0).withColumn("UCP", F.lit("b"))
    d = a.unionByName(b)
    hol = X.holidays(d)
    score = lambda f: f.withColumn("demanda_predicha", F.coalesce(0.4 * F.col("total_lag_1d") + 0.3 * F.col("total_lag_7d") + 0.2 * F.col("total_lag_14d") + 0.1 * F.col("total_lag_1y") + F.col("days_since_holiday") / 100 + F.col("total_rolling_mean_7d") / 1000 + F.col("total_day_change_pct") / 10, F.lit(1.0)))
    got = {(r["UCP"], r["FECHA"]): r["demanda_predicha"] for r in FC.forecast_recursive(d, weather, hol, K, 4, score).collect()}
    want = rebuilt(d, weather, hol, 4, score)
    assert len(got) == 8 and ("a", D(2020, 5, 1)) in got
    assert got == pytest.approx(want)
    assert {(r["UCP"], r["FECHA"]): r["demanda_predicha"] for r in FC.forecast_recursive(d, weather, hol, K, 4, score, every=3).collect()} == pytest.approx(want)
    assert FC.forecast_recursive(d.where("false"), weather, hol, K, 2, score).count() == 0
    with pytest.raises(ValueError):
        FC.forecast_recursive(d, weather, hol, K, 365, score)


def test_a_recursive_step_reads_no_history(spark, weather):
    d = series(spark, days(D(2020, 2, 1), [100.0 + k for k in range(60)]))
    state = FC.recursive_state(d, weather, X.holidays(d), K, 3).checkpoint()
    plan = FC.recursive_features(state)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Exchange", "Window", "LocalTableScan", "FileScan"))
    assert state.count() == 1


def chained(asked, end, history, pause=30, least=30):
    """The rule, day by day."""
    out, tried = [], None
    for day in sorted(set(asked)):
        if tried is not None and (day - tried).days <= pause or end is not None and end - datetime.timedelta(90) <= day <= end + datetime.timedelta(30):
            continue
        past = [h for h in history if h <= day]
        tried = day
        if len(past) >= least:
            end = max(past)
        out.append((day, len(past), end, len(past) >= least))
    return out


def test_refit_chain(spark):
    """Tries that fail for want of rows, days before the training's reach, a key without training, days without history."""
    day = lambda k: D(2020, 1, 1) + datetime.timedelta(k)
    history = {"a": [day(k) for k in range(400) if k % 3], "b": [day(k) for k in range(0, 300, 20)], "c": [day(k) for k in range(60)]}
    asked = {"a": [day(k) for k in range(-200, 900, 2)], "b": [day(k) for k in range(300)], "c": [day(k) for k in range(50, 60)] + [day(70)] * 3, "d": [day(5)]}
    ends = {"a": day(50), "b": day(10), "d": day(4)}
    frame = lambda x: spark.createDataFrame([(k, v, "clash") for k, vs in x.items() for v in vs] + [("a", None, "clash")], "UCP string, FECHA date, end string")
    e = spark.createDataFrame(list(ends.items()), "UCP string, trained_to date")
    got = {}
    for r in H.refit_chain(frame(asked), e, frame(history), K).orderBy("UCP", "FECHA").collect():
        got.setdefault(r["UCP"], []).append((r["FECHA"], r["rows"], r["trained_to"], r["refit"]))
    want = {k: w for k in asked if (w := chained(asked[k], ends.get(k), history.get(k, [])))}
    assert got == want
    assert any(not x[3] for x in got["b"]) and len(got["a"]) > 5 and "c" in got and "d" not in got
    assert H.refit_chain(frame(asked).where("false"), e, frame(history), K).count() == 0


def test_each_refit_learns_from_its_own_days(spark):
    d = hourly(spark, D(2020, 1, 1), 260, f=lambda k, h: 10 + h + (k + h) % 7)
    hol = X.holidays(d)
    ends = d.select("UCP").distinct().withColumn("trained_to", F.to_date(F.lit("2020-02-01")))
    chain = H.refit_chain(d.select("UCP", "FECHA"), ends, d, K)
    dates = [r["FECHA"] for r in chain.where("refit").orderBy("FECHA").collect()]
    assert len(dates) >= 4
    own = H.refit_days(d, hol, chain, K)
    for at in (dates[0], dates[-1]):
        want = {(r["FECHA"], tuple(r["profile"])) for r in H.normal_days(d, hol, K, asof=str(at)).collect()}
        assert {(r["FECHA"], tuple(r["profile"])) for r in own.where(F.col("asof") == F.lit(at)).collect()} == want and len(want) > 30
    rows = H.split_by_refits(d.select("UCP", "FECHA", "TOTAL"), d, hol, chain, K).select("FECHA", "asof", "sum_valid", "cluster_id").collect()
    assert len(rows) == 260 and all(r["sum_valid"] for r in rows)
    assert all(r["asof"] == max([x for x in dates if x <= r["FECHA"]], default=None) and (r["cluster_id"] is None) == (r["asof"] is None) for r in rows)


@pytest.fixture(scope="module")
def trained(spark):
    """Two keys, one of which follows the weekday, one the day of the month; a model for each."""
    d = series(spark, days(D(2020, 1, 1), [100.0 + 20 * (k % 7) for k in range(140)]))
    e = series(spark, days(D(2020, 1, 1), [300.0 + (k * 37 % 31) for k in range(140)])).withColumn("TOTAL", 300.0 + 5 * F.dayofmonth("FECHA")).withColumn("UCP", F.lit("b"))
    f = d.unionByName(e).withColumns({"dow": F.weekday("FECHA"), "dom": F.dayofmonth("FECHA")})
    s = ML.temporal_split(f, K)
    kinds = {"forest": ML.estimators()["forest"], "flat": ML.estimators()["boosted_flat"]}
    first = ML.train(s.where("split = 'train' and UCP = 'a'"), ["dow", "dom"], models={"forest": kinds["forest"]})
    second = ML.train(s.where("split = 'train' and UCP = 'b'"), ["dow", "dom"], models={"flat": kinds["flat"]})
    return s, {**first, **second}


def test_champions_from_the_store_equal_scoring_key_by_key(spark, trained, tmp_path):
    s, models = trained
    best = ML.champions(models, s.where("split = 'validation'"), K, "mape")
    ML.save_models(models, best, str(tmp_path))
    loaded, chosen = ML.load_models(spark, str(tmp_path))
    assert list(loaded) == ["forest", "flat"] and {r["UCP"]: r["model"] for r in chosen.collect()} == {"a": "forest", "b": "flat"}
    more = s.unionByName(s.limit(1).withColumn("UCP", F.lit("new"))).unionByName(s.limit(1).withColumn("UCP", F.lit(None).cast("string")))
    got = sorted((str(r["UCP"]), r["FECHA"], r["model"], r["demanda_predicha"]) for r in ML.score_with_champions(loaded, chosen, more, K, default="flat").collect())
    want = []
    for key, name in (("a", "forest"), ("b", "flat"), ("new", "flat"), (None, "flat")):
        want += [(str(key), r["FECHA"], name, r["demanda_predicha"]) for r in ML.score(models[name], more.where(F.col("UCP").eqNullSafe(F.lit(key)))).collect()]
    assert got == sorted(want)
    assert {r["model"] for r in ML.score_with_champions(loaded, chosen, more.where("UCP = 'new'"), K).collect()} == {None}


def test_cross_validation_equals_one_fit_after_another(spark, trained):
    s, _ = trained
    d, kinds = s.drop("split"), {"forest": ML.estimators()["forest"]}
    got = ML.cross_validate(d, ["dow", "dom"], K, models=kinds).first()
    folds, mapes = ML.cv_folds(d, K), []
    for k in (1, 2, 3):
        m = ML.train(folds.where(f"fold = {k} and role = 'train'"), ["dow", "dom"], models=kinds)
        mapes.append(error_metrics(ML.score(m["forest"], folds.where(f"fold = {k} and role = 'test'")), "TOTAL", "demanda_predicha", []).first()["mape"])
    mean = sum(mapes) / 3
    assert got["mape_mean"] == pytest.approx(mean, rel=0.05)  # bootstrap samples depend on how rows are partitioned
    assert got["mape_std"] == pytest.approx((sum((x - mean) ** 2 for x in mapes) / 3) ** 0.5, rel=0.3, abs=0.3)
