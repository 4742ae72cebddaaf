"""The library's three main flows, each a composition of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from wattloom.operators import cleaning as C
from wattloom.operators import features as E
from wattloom.operators import forecast as F_
from wattloom.operators import metrics as M
from wattloom.operators import profiles as H
from wattloom.schema import KEYS
from wattloom.sources.files import write_table


def ingest(demand: DataFrame, weather_hourly: DataFrame, keys: list[str] = KEYS, out: str | None = None) -> dict[str, DataFrame]:
    """Raw demand and hourly weather to clean tables and features; written under `out` if it is given."""
    power = C.clean_demand(demand)
    weather = C.clean_weather(C.weather_daily(weather_hourly, keys))
    tables = {"demand": power, "weather": weather, "features": E.build_features(power, weather, keys)}
    if out:
        for name, df in tables.items():
            write_table(df, f"{out}/{name}", keys=keys)
    return tables


def predict(demand: DataFrame, weather: DataFrame, holidays: DataFrame, keys: list[str], n: int, score: Callable[[DataFrame], DataFrame], offset: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(forecast of n days with its hours, summary by key): features, model, adjustment, hourly split, offset."""
    f = F_.forecast_direct(F_.serving_features(demand, weather, holidays, keys, n), score)
    model = H.fit_hourly(demand, holidays, keys)
    split = H.split_days(f.select(*keys, "FECHA", "demanda_predicha").withColumnRenamed("demanda_predicha", "TOTAL"), model, holidays, keys)
    split = F_.apply_offset(split, offset, "TOTAL", "hours")
    return split, F_.summary(split, keys, "FECHA", "TOTAL")


def backtest(demand: DataFrame, keys: list[str], predict_from: Callable[[DataFrame], DataFrame], days: int = 30) -> DataFrame:
    """The retraining decision of each key from the last `days`, held out: (keys, metrics, consecutive, reason)."""
    past, actual = F_.backtest_frame(demand, keys, days)
    e = M.with_errors(F_.with_actuals(predict_from(past), actual, keys), "real", "demanda_predicha")
    m = M.error_metrics(e, "real", "demanda_predicha", keys)
    return M.retrain_decision(m.join(M.consecutive_days(e, keys), keys))
