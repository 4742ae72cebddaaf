"""Edges of the core operators on small frames, and invariants of the fitted ones."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from wattloom import fixtures as X
from wattloom.functions.calendar import classify_days, day_class
from wattloom.operators import basecurve as B
from wattloom.operators import cleaning as C
from wattloom.operators import features as E
from wattloom.operators import forecast as FC
from wattloom.operators import metrics as M
from wattloom.operators import models as ML
from wattloom.operators import profiles as H
from wattloom.schema import HOURS
from wattloom.session import prepare
from wattloom.sources import files as S

K = ["UCP"]


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_queries_leave_the_session_as_it_is(spark):
    own = prepare(spark)
    assert own is not spark and own.conf.get("spark.sql.constraintPropagation.enabled") == "false"
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.constraintPropagation.enabled", "true")
    prepare(spark)
    assert spark.conf.get("spark.sql.constraintPropagation.enabled") == "true"
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")


D = dt.date


def series(spark, rows, key="a"):
    return spark.createDataFrame([(key, d, None if v is None else float(v)) for d, v in rows], "UCP string, FECHA date, TOTAL double")


def days(start, values):
    return [(start + dt.timedelta(days=k), v) for k, v in enumerate(values)]


def by_date(df, col):
    return {r["FECHA"]: r[col] for r in df.collect()}


def hourly(spark, start, n, key="a", f=lambda k, h: 40 + 10 * math.sin(2 * math.pi * h / 24) + k % 7):
    rows = [(key, start + dt.timedelta(days=k), *[float(f(k, h)) for h in range(24)]) for k in range(n)]
    d = spark.createDataFrame(rows, "UCP string, FECHA date, " + ", ".join(f"{h} double" for h in HOURS))
    return d.withColumn("TOTAL", sum((F.col(h) for h in HOURS[1:]), F.col("P1")))


def test_row_lag_is_not_a_calendar_lag(spark):
    d = series(spark, [(D(2020, 1, 1), 1), (D(2020, 1, 5), 2), (D(2020, 1, 6), 3)])
    assert by_date(E.row_lags(d, K, lags=[1]), "total_lag_1d")[D(2020, 1, 5)] == 1


def test_annual_lags_leap_day_duplicates_and_fallback(spark):
    d = series(spark, [(D(2019, 2, 28), 5), (D(2020, 2, 28), 7), (D(2020, 2, 29), 9), (D(2020, 2, 29), 9), (D(2021, 2, 28), 11)])
    got = E.annual_lags(d, K)
    assert got.count() == 5
    one = by_date(got, "total_lag_1y")
    assert one[D(2020, 2, 29)] == 5 and one[D(2021, 2, 28)] == 7
    assert one[D(2019, 2, 28)] == 6  # the mean of this lag over 28 February: (5 + 7) / 2
    assert by_date(got, "total_lag_3y")[D(2019, 2, 28)] == pytest.approx(8.2)  # nobody has one: the mean of all


def test_rolling_leaves_christmas_out(spark):
    d = series(spark, days(D(2020, 12, 10), [float(k) for k in range(1, 41)]))
    got = by_date(E.rolling_stats(d, K, windows=[7]), "total_rolling_mean_7d")
    assert got[D(2020, 12, 10)] == 1  # fewer than three values: the plain window
    assert got[D(2020, 12, 25)] == pytest.approx((10 + 11 + 12 + 13) / 4)  # 19 to 22 December
    assert got[D(2021, 1, 3)] == pytest.approx(sum(range(19, 26)) / 7)  # all Christmas: the plain window


def test_rolling_shift_keeps_the_target_out(spark):
    d = series(spark, days(D(2020, 3, 1), [1.0, 2.0, 3.0, 100.0]))
    assert by_date(E.rolling_stats(d, K, windows=[7], shift=1), "total_rolling_mean_7d")[D(2020, 3, 4)] == 2


def test_day_change_over_gaps_and_zero(spark):
    d = series(spark, days(D(2020, 3, 1), [10, None, 20, 0, 5]))
    pct = by_date(E.day_change(d, K), "total_day_change_pct")
    assert pct[D(2020, 3, 2)] == 0 and pct[D(2020, 3, 3)] == 100 and pct[D(2020, 3, 5)] is None


def test_days_since_holiday(spark):
    rows = [("a", D(2020, 1, 1) + dt.timedelta(days=k), int(k in (3, 4))) for k in range(40)]
    d = spark.createDataFrame(rows, "UCP string, FECHA date, is_festivo int")
    got = by_date(E.days_since_holiday(d, K), "days_since_holiday")
    assert [got[D(2020, 1, 1) + dt.timedelta(days=k)] for k in (0, 3, 4, 5, 33, 39)] == [30, 0, 0, 1, 29, 30]


def test_feature_set_has_its_68_names(spark):
    d = hourly(spark, D(2020, 1, 1), 20).withColumns({"VARIABLE": F.lit("v"), "Clasificador interno": F.lit("n"), "TIPO DIA": F.lit("LUNES")})
    w = C.weather_daily(spark.createDataFrame([("a", D(2020, 1, 1) + dt.timedelta(days=k), 1, 20.0, 50.0, 1.0, 2.0) for k in range(20)], "UCP string, fecha date, periodo int, p_t double, p_h double, p_v double, p_i double"), K)
    clean = C.clean_demand(d)
    f = E.build_features(clean, w, K)
    names = [*E.feature_names(f, clean.columns)]
    assert len(names) == len(set(names)) == 68  # the text column season aside
    assert f.count() == 20 and E.feature_counts(f, names).agg(F.sum("nulls")).first()[0] == 0
    assert {r["temp_std"] for r in w.collect()} == {2.5}
    assert E.fill_mean(f, names).count() == 20


def test_day_class_isn_t_idempotent(spark):
    d = spark.createDataFrame([("Lunes",), ("MIÉRCOLES",), ("SÁBADO",), (None,), ("LABORAL",)], "t string")
    assert [r[0] for r in d.select(day_class("t")).collect()] == ["LABORAL", "LABORAL", "FESTIVO", "FESTIVO", "FESTIVO"]


def test_calendar_cases(spark):
    d = series(spark, [(D(2024, 12, 25), 1), (D(2024, 3, 15), 1), (D(2024, 3, 16), 1), (D(2024, 4, 15), 1), (D(2024, 1, 15), 1), (D(2024, 5, 1), 1)])
    hol = spark.createDataFrame([("a", D(2024, 12, 25), None), ("a", D(2024, 5, 1), "x"), ("b", D(2024, 3, 15), None)], "UCP string, FECHA date, nombre string")
    got = {r["FECHA"]: r for r in classify_days(d, hol, K).collect()}
    assert got[D(2024, 12, 25)]["tipo_dia"] == "festivo" and got[D(2024, 12, 25)]["nombre_festivo"] == "Navidad"
    assert got[D(2024, 3, 15)]["tipo_dia"] == "laboral" and got[D(2024, 3, 16)]["tipo_dia"] == "fin_de_semana"
    assert got[D(2024, 4, 15)]["temporada"] == "lluviosa" and got[D(2024, 1, 15)]["temporada"] == "seca" and got[D(2024, 5, 1)]["dia_especial"]


def test_append_keeps_the_old_row(spark):
    a, b = series(spark, [(D(2020, 1, 1), 1)]), series(spark, [(D(2020, 1, 1), 2), (D(2020, 1, 2), 3)])
    assert by_date(C.append_demand(a, b, K), "TOTAL") == {D(2020, 1, 1): 1, D(2020, 1, 2): 3}


def test_schema_report_and_event_day(spark):
    d = spark.createDataFrame([("a", "", "x"), ("b", None, "x"), ("c", "2", "x")], "UCP string, EVENTO string, `Unnamed: 0` string")
    assert C.schema_alerts(d, ["UCP", "TOTAL"]).collect()[0]["column"] == "TOTAL"
    assert [r["EVENTO"] for r in C.event_day(d).orderBy("UCP").collect()] == ["0", "0", "2"]
    assert C.drop_unnamed(d).columns == ["UCP", "EVENTO"] and C.keep_expected(d, ["UCP", "z"]).columns == ["UCP"]


def test_csv_and_json_sources(spark, tmp_path):
    head = ["UCP", "VARIABLE", "FECHA", "Clasificador interno", "TIPO DIA", *HOURS, "TOTAL"]
    row = lambda d, p1: ",".join(["a", "v", d, "n", "LUNES", p1, *["1"] * 23, "24"])
    (tmp_path / "d.csv").write_text("\n".join([",".join(head), row("2024-01-01", "1"), row("bad", "1"), row("2024-01-03", "oops"), row("2024-02-01", "1")]))
    got = S.read_demand_csv(spark, f"file://{tmp_path}/d.csv")
    assert got.where("FECHA is null").count() == 1 and got.where("P1 is null").count() == 1
    assert S.read_demand_csv(spark, f"file://{tmp_path}/d.csv", "2024-01-01", "2024-01-03").count() == 2
    (tmp_path / "w.csv").write_text("UCP,fecha,periodo,p_t,p_h,p_v,p_i\na,2024-01-01,1,20,50,1,0\na,never,2,20,50,1,0\n")
    assert S.read_weather_csv(spark, f"file://{tmp_path}/w.csv").count() == 1
    with pytest.raises(ValueError):
        S.check_weather(got)
    (tmp_path / "f.json").write_text(json.dumps({"data": [{"fecha": "2024-01-01", **{f"p{h}": h for h in range(1, 25)}}, {"fecha": "2024-01-02", "p1": 5}]}))
    feed = {r["FECHA"]: r for r in S.read_demand_feed(spark, f"file://{tmp_path}/f.json", "u").collect()}
    assert feed[D(2024, 1, 1)]["TOTAL"] == 300 and feed[D(2024, 1, 1)]["TIPO DIA"] == "LUNES" and feed[D(2024, 1, 2)]["TOTAL"] == 5
    (tmp_path / "g.json").write_text(json.dumps({"data": [{"fecha": "2024-01-01", "p3_t": 7, "p3_i": 1}]}))
    weather = S.read_weather_feed(spark, f"file://{tmp_path}/g.json")
    assert weather.count() == 24 and weather.where("periodo = 3 and p_t = 7 and p_h is null").count() == 1
    (tmp_path / "h.json").write_text(json.dumps({"festivos": ["2024-01-01", "2024-05-01"], "descripcion_festivos": {"2024-01-01": "Año Nuevo"}}))
    assert [tuple(r) for r in S.read_holidays(spark, f"file://{tmp_path}/h.json", "u", end="2024-02-01").collect()] == [("u", D(2024, 1, 1), "Año Nuevo")]
    S.write_table(got.where("FECHA is not null"), f"file://{tmp_path}/out")
    S.write_forecast(feed_df := series(spark, [(D(2024, 1, 1), 1)]), feed_df.agg(F.count("*").alias("n")), f"file://{tmp_path}/fc")
    S.write_results(feed_df, f"file://{tmp_path}/res")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 3 and spark.read.json(f"file://{tmp_path}/fc/summary").first()["n"] == 1


def test_quality_limits(spark):
    rows = [("a", None if k < 6 else 1.0, 1.0 if k else 100.0) for k in range(100)]
    d = spark.createDataFrame(rows, "UCP string, x double, y double")
    got = {r["column"]: r["status"] for r in C.null_percentages(d, ["x", "y"]).collect()}
    assert got == {"x": "ALERT", "y": "OK"}
    assert {r["column"]: r["outliers"] for r in C.sigma_outliers(d, ["y"], K).collect()} == {"y": 1}
    assert C.iqr_outliers(d, "y", K).first()["outliers"] == 1


Y = [100.0, 200.0, 300.0, 400.0, 500.0]


@pytest.mark.parametrize("p,mape,r", [(Y, 0, 1), (Y[::-1], None, -1), ([103.0, 206.0, 297.0, 412.0, 495.0], 2.2, None)])
def test_metric_cases(spark, p, mape, r):
    m = M.error_metrics(spark.createDataFrame(list(zip(Y, p)), "y double, p double"), "y", "p").first()
    if mape is not None:
        assert m["mape"] == pytest.approx(mape)
    if r is not None:
        assert m["r"] == pytest.approx(r)
    if r == -1:
        assert m["rmape"] == math.inf


def test_metric_edges(spark):
    one = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    assert M.error_metrics(one, "y", "p").first()["mape"] == math.inf and M.error_metrics(one, "y", "p").first()["r"] == 0
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double")
    assert M.error_metrics(flat, "y", "p").first()["r"] is None
    assert M.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").first()["n"] == 2


def test_consecutive_days(spark):
    d = spark.createDataFrame([("a", D(2020, 1, k + 1), e) for k, e in enumerate([1.0, 9.0, 1.0, 9.0, 9.0, 9.0, None])] + [("b", D(2020, 1, 1), 9.0)], "UCP string, FECHA date, abs_error_pct double")
    got = {r["UCP"]: r for r in M.consecutive_days(d, K).collect()}
    assert got["a"]["days"] == [D(2020, 1, 4), D(2020, 1, 5), D(2020, 1, 6)] and not got["b"]["consecutive"]
    m = spark.createDataFrame([("a", 6.0, True), ("b", 6.0, False), ("c", 1.0, True), ("d", 1.0, False)], "UCP string, mape double, consecutive boolean")
    assert [r["reason"] for r in M.retrain_decision(m).orderBy("UCP").collect()] == ["ambos", "mensual", "consecutivo", None]


def test_champion_ties_and_infinite(spark):
    d = spark.createDataFrame([("k", "x", math.inf), ("k", "b", 2.0), ("k", "a", 2.0), ("z", "a", None)], "UCP string, model string, rmape double")
    assert [(r["UCP"], r["model"]) for r in M.champion(d, K, order=["b", "a"]).collect()] == [("k", "b")]


def test_as_of(spark):
    h = series(spark, [(D(2020, 1, 2), 2), (D(2020, 1, 4), None), (D(2020, 1, 4), None), (D(2020, 1, 8), 8)])
    t = spark.createDataFrame([("a", D(2020, 1, d)) for d in (1, 2, 3, 4, 9)] + [("none", D(2020, 1, 1))], "UCP string, at date")
    got = {(r["UCP"], r["at"].day): r["TOTAL"] for r in FC.as_of(t, h, K, "at", ["TOTAL"]).collect()}
    assert got == {("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("a", 4): None, ("a", 9): 8, ("none", 1): 0}


def test_anchored_rolling_tiers(spark):
    d = series(spark, days(D(2020, 12, 1), [float(k) for k in range(1, 38)]))  # to 6 January
    r = FC.anchored_rolling(d, K, windows=(7, 28)).first()
    assert r["total_rolling_mean_7d"] == pytest.approx(sum(range(31, 38)) / 7)  # nothing left in 14 days: Christmas comes in
    assert r["total_rolling_mean_28d"] == pytest.approx(sum(range(1, 23)) / 22)  # 10 to 22 December: 12 of 14, so the window doubles


def test_climate_normals_defaults(spark):
    w = spark.createDataFrame([("a", D(2020, 1, 1), 20.0, 0.0)], "UCP string, FECHA date, temp_mean double, rain_sum double")
    got = {r["month"]: r["temp_mean"] for r in FC.climate_normals(w, K, {"temp_mean": 22.0, "rain_sum": 0.0}).collect()}
    assert len(got) == 12 and got[1] == 20 and got[2] == 22


def test_adjustment_weights(spark):
    rows = [(D(2024, 12, 25), True, 10.0), (D(2024, 5, 1), True, 10.0), (D(2024, 12, 28), False, 10.0), (D(2024, 12, 30), False, 10.0), (D(2024, 12, 24), False, 0.0)]
    d = spark.createDataFrame(rows, "FECHA date, es_festivo boolean, total_lag_1y double").withColumn("demanda_predicha", F.lit(20.0))
    assert by_date(FC.adjust(d), "demanda_predicha") == pytest.approx({D(2024, 12, 25): 13, D(2024, 5, 1): 14, D(2024, 12, 28): 14, D(2024, 12, 30): 20, D(2024, 12, 24): 20})


@pytest.fixture(scope="module")
def fitted(spark):
    d = hourly(spark, D(2023, 1, 1), 500)
    hol = X.holidays(d)
    return d, hol, H.fit_hourly(d, hol, K, clusters=(6, 4))


def test_profiles_sum_to_one_and_split_to_the_total(spark, fitted):
    d, hol, model = fitted
    for t in (model.normal, model.special):
        assert all(abs(sum(r["profile"]) - 1) < 1e-9 for r in t.collect())
    t = series(spark, [(D(2024, 3, 15), 1500), (D(2024, 12, 25), 1400), (D(2024, 1, 2), 1300)]).unionByName(series(spark, [(D(2024, 3, 15), 10)], "unknown"))
    got = {(r["UCP"], r["FECHA"]): r for r in H.split_days(t, model, hol, K).collect()}
    assert all(r["sum_valid"] and abs(sum(r[h] for h in HOURS) - r["TOTAL"]) < 0.01 for r in got.values()) and len(got) == 4
    assert got["a", D(2024, 12, 25)]["method"] == got["a", D(2024, 1, 2)]["method"] == "special" and got["a", D(2024, 3, 15)]["method"] == "normal" and got["unknown", D(2024, 3, 15)]["method"] == "fallback"
    again = H.fit_hourly(d, hol, K, clusters=(6, 4))
    assert sorted(map(tuple, again.by_weekday.collect())) == sorted(map(tuple, model.by_weekday.collect()))
    pooled = H.cluster_days_pooled(H.normal_days(d, hol, K), 3, (1, 2))
    assert pooled.select("cluster").distinct().count() <= 3
    assert H.refit_needed(series(spark, [(D(2030, 1, 1), 1)]), model.ends, d, K).first()["refit"]


def test_mode_ties_go_to_the_lowest(spark):
    d = spark.createDataFrame([("a", D(2024, 1, 1), 3), ("a", D(2024, 1, 8), 1)], "UCP string, FECHA date, cluster int")
    assert H.cluster_by(d, K, F.weekday("FECHA"), "dow").first()["cluster"] == 1


def test_base_curves_routes(spark, fitted):
    d, hol, model = fitted
    got = {r["FECHA"]: r for r in B.base_curves(d, "2024-04-20", "2024-05-20", hol, K, model).collect()}
    assert len(got) == 31 and all(len(r["curve"]) == 24 and min(r["curve"]) > 0 for r in got.values())
    assert got[D(2024, 5, 1)]["source"] == "same_day" and got[D(2024, 5, 2)]["source"] == "normal_cluster"
    alone = {r["FECHA"]: r["source"] for r in B.base_curves(d, "2023-12-20", "2024-01-10", hol, K).collect()}
    assert alone[D(2023, 12, 25)] == "flat" and alone[D(2024, 1, 1)] == "same_day" and alone[D(2024, 1, 2)] == "christmas_history"


def test_base_curve_tiers(spark):
    hist = [D(2022, 1, 3), D(2024, 1, 15)]  # two Mondays
    d = hourly(spark, D(2022, 1, 1), 1).where("false")
    for k, x in enumerate(hist):
        d = d.unionByName(hourly(spark, x, 1, f=lambda _, h, k=k: k + 1))
    hol = X.holidays(d)
    h = B.history_of(d, hol, K)

    def tier(day):
        t = B.targets(d, str(day), str(day), hol, K)
        return B.normal_tiers(t, h, K).first()["tier"]

    assert tier(D(2024, 2, 26)) == 1 and tier(D(2024, 1, 22)) == 2 and tier(D(2024, 3, 11)) == 3
    assert tier(D(2025, 1, 20)) == 4 and tier(D(2025, 6, 3)) == 5 and tier(D(2030, 6, 3)) == 7


def test_clamp(spark):
    d = spark.createDataFrame([([10.0, 0.0, 20.0], [10.0, 5.0, 0.0], 33.0)], "hours array<double>, ref array<double>, TOTAL double")
    r = B.clamp_to_reference(d).first()["adjusted"]
    assert sum(r) == pytest.approx(33) and r[1] / r[0] == pytest.approx(4.75 / 10)
    assert B.padded(F.array(F.lit(1.0))) is not None


def test_splits_and_folds(spark):
    d = series(spark, days(D(2020, 1, 1), list(range(10))))
    assert {r["split"]: r["count"] for r in ML.temporal_split(d, K).groupBy("split").count().collect()} == {"train": 8, "validation": 2}
    f = ML.cv_folds(d, K)
    assert {(r["fold"], r["role"]): r["count"] for r in f.groupBy("fold", "role").count().collect()} == {(1, "train"): 4, (1, "test"): 2, (2, "train"): 6, (2, "test"): 2, (3, "train"): 8, (3, "test"): 2}


def test_trees_beat_the_mean_and_recursion_runs(spark):
    d = series(spark, days(D(2020, 2, 1), [100 + 20 * (k % 7) for k in range(120)]))
    f = E.row_lags(d, K).where("total_lag_14d is not null").withColumn("dow", F.weekday("FECHA"))
    models = {"forest": ML.estimators()["forest"]}
    fitted_models = ML.train(f, ["dow"], models=models)
    assert ML.evaluate(fitted_models, f, []).first()["mape"] < 5
    assert ML.importances(fitted_models, f, ["dow"]).first()["feature"] == "dow"
    cv = ML.cross_validate(f, ["dow"], K, models=models).first()
    assert cv["mape_mean"] < 10
    w = spark.createDataFrame([("a", D(2020, 1, 1), 20.0, 16.0, 28.0, 70.0, 2.0, 0.0, 0.0)], "UCP string, FECHA date, temp_mean double, temp_min double, temp_max double, humidity_mean double, wind_speed_mean double, rain_mean double, rain_sum double")
    spark.sparkContext.setCheckpointDir("/tmp/wattloom-checkpoints")
    got = FC.forecast_recursive(d, w, X.holidays(d), K, 2, lambda x: x.withColumn("demanda_predicha", F.col("total_lag_7d"))).orderBy("FECHA").collect()
    assert [r["demanda_predicha"] for r in got] == [100 + 20 * (k % 7) for k in (120, 121)]


def test_flows(spark, fitted):
    from wattloom.plans import flows

    d, hol, _ = fitted
    naive = lambda past: FC.lagged(FC.horizon(past, 30, K), past.select("UCP", "FECHA", "TOTAL"), K, F.date_sub("FECHA", 28), {"TOTAL": "demanda_predicha"})
    r = flows.backtest(d, K, naive).first()
    assert r["n"] == 30 and r["reason"] in (None, "mensual", "ambos", "consecutivo")
