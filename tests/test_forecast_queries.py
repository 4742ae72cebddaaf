"""Registered queries that fit models use the operators' own values."""

import pytest

from wattloom.operators import models as ML
from wattloom.operators import profiles as H
from wattloom.plans import forecast_queries as Q
from wattloom.session import prepare


def test_split_queries_fit_all_clusters(spark, sf):
    d, hol, model = Q._model(spark, sf)
    for profiles, days, most in ((model.normal, H.normal_days(d, hol, Q.KEYS), H.CLUSTERS_NORMAL), (model.special, H.special_days(d, hol, Q.KEYS), H.CLUSTERS_SPECIAL)):
        # the key with most days has enough different ones for every cluster
        kinds = {r["UCP"]: r["n"] for r in days.selectExpr("UCP", "transform(profile, x -> round(x, 9)) as p").distinct().groupBy("UCP").count().withColumnRenamed("count", "n").collect()}
        got = {r["UCP"]: r["n"] for r in profiles.groupBy("UCP").count().withColumnRenamed("count", "n").collect()}
        key = max(kinds, key=kinds.get)
        assert got[key] > (8 if most == H.CLUSTERS_NORMAL else 5)
        assert all(n <= most for n in got.values())


def test_training_takes_every_estimator(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.ML, "train", lambda df, names, models=None: seen.append(models or Q.ML.estimators()))
    monkeypatch.setattr(Q.ML, "evaluate", lambda *a: None)
    Q.model_training(prepare(spark), sf)
    assert set(seen[0]) == set(Q.ML.estimators())


def test_curves_reach_the_profile_rules(spark, sf):
    got = {r["source"] for r in Q.R.queries["curve_base_profiles"](spark, sf).select("source").distinct().collect()}
    assert "normal_cluster" in got


def test_a_fit_reads_stored_rows(spark):
    """A fit is some hundred jobs: its rows must not carry the plan that made them, nor the partitions of a shuffle."""
    seen = []

    class Fit:
        def fit(self, v):
            seen.append(v)
            return ML.VectorAssembler(inputCols=["x"], outputCol="y")

    own = prepare(spark)
    own.conf.set("spark.sql.shuffle.partitions", "40")
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = own.range(400).selectExpr("id % 90 as k", "cast(id as double) as x", "1.0 as TOTAL").groupBy("k").sum("x", "TOTAL").toDF("k", "x", "TOTAL")
    ML.train(df, ["x"], models={"one": Fit(), "two": Fit()})
    assert len(seen) == 2 and all(v.count() == 90 for v in seen)
    for v in seen:
        plan = v._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" in plan and not any(x in plan for x in ("InMemoryTableScan", "Exchange", "Aggregate"))
        assert v.rdd.getNumPartitions() < 40


@pytest.mark.parametrize("name", ["model_training", "model_fitted_importances"])
def test_training_rows_are_stored(spark, sf, monkeypatch, name):
    seen = []

    def train(df, names, models=None):
        seen.append(df)
        raise InterruptedError  # what follows is not of interest

    monkeypatch.setattr(Q.ML, "train", train)
    with pytest.raises(InterruptedError):
        getattr(Q, name)(prepare(spark), sf)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and not any(x in plan for x in ("InMemoryTableScan", "Exchange", "Window", "Join"))


@pytest.mark.parametrize("name, where, step", [
    ("forecast_champion", "E", "build_features"), ("model_champion_trained", "E", "build_features"), ("forecast_recursive_trained", "E", "build_features"),
    ("forecast_recursive_linear", "F_", "forecast_recursive"), ("forecast_serving_features", "F_", "serving_features"), ("forecast_direct", "F_", "serving_features"),
])
def test_days_are_made_once(spark, sf, monkeypatch, name, where, step):
    """Features and forecasts look days up many times; none of the lookups may aggregate the orders and line items again."""
    seen = []

    def taken(demand, weather, *rest, **more):
        seen.extend((demand, weather))
        raise InterruptedError  # what follows is not of interest

    monkeypatch.setattr(getattr(Q, where), step, taken)
    with pytest.raises(InterruptedError):
        getattr(Q, name)(prepare(spark), sf)
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" in plan and not any(x in plan for x in ("orders.parquet", "lineitem.parquet", "Exchange", "Aggregate", "Join"))
