"""Forecasts of the next N days for all keys at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.calendar import calendar_features, cyclic_features, holiday_flags, is_christmas, mmdd, season_features, weekday_name
from wattloom.functions.expressions import flag, scaled
from wattloom.operators.features import interaction_features
from wattloom.session import scratch

#: Month normals where no weather is known, and defaults of serving.
CLIMATE_DEFAULTS = {"temp_mean": 22.0, "temp_min": 16.0, "temp_max": 28.0, "humidity_mean": 70.0, "wind_speed_mean": 2.0, "rain_mean": 0.0, "rain_sum": 0.0}
#: Weights of last year's value.
VERY_SPECIAL, W_VERY_SPECIAL, W_SPECIAL = ["12-24", "12-25", "12-08", "01-01", "01-02"], 0.70, 0.60


def horizon(history: DataFrame, n: int, keys: list[str], date: str = "FECHA") -> DataFrame:
    """(keys, last_day, FECHA): the n days after each key's last day."""
    last = history.groupBy(*keys).agg(F.max(date).alias("last_day"))
    return last.select(*keys, "last_day", F.explode(F.sequence(F.date_add("last_day", 1), F.date_add("last_day", n))).alias("FECHA"))


def as_of(targets: DataFrame, history: DataFrame, keys: list[str], at: str, values: list[str], date: str = "FECHA") -> DataFrame:
    """targets with values of history on the date `at`, else of the latest day before, else of the key's first
    day, else 0.  A known day whose value is null stays null.  Union of both sides and one window by key: no
    range join.  Of repeated dates the largest struct of values counts."""
    v = F.struct(*[F.col(c).alias(c) for c in values])
    h = history.groupBy(*keys, F.col(date).alias("__at")).agg(F.max(v).alias("__v"))
    first = h.groupBy(*keys).agg(F.min_by("__v", "__at").alias("__first"))
    t = targets.select(*keys, F.col(at).alias("__at")).distinct()
    both = h.withColumn("__t", F.lit(False)).unionByName(t.withColumn("__t", F.lit(True)).withColumn("__v", F.lit(None).cast(h.schema["__v"].dataType)))
    # on one date the history row (False) comes before the target
    w = Window.partitionBy(*keys).orderBy("__at", "__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__f", F.last("__v", ignorenulls=True).over(w)).where("__t").select(*keys, F.col("__at").alias(at), "__f")
    d = targets.drop(*[c for c in values if c in targets.columns]).join(found, [*keys, at], "left").join(first, keys, "left")
    got = F.when(F.col("__f").isNotNull(), F.col("__f")).otherwise(F.col("__first"))
    return d.withColumns({c: F.when(got.isNull(), F.lit(0.0)).otherwise(got[c]) for c in values}).drop("__f", "__first")


def anchored_rolling(history: DataFrame, keys: list[str], value: str = "TOTAL", windows: tuple[int, ...] = (7, 14, 28)) -> DataFrame:
    """One row a key: mean, population std, min and max over the last N calendar days up to its last day,
    without Christmas; with fewer than max(3, N // 2) values over twice the days; with fewer than 3 then
    over N days with Christmas.  An empty window takes the next shorter one's.  One grouped pass over the
    last 56 days."""
    last = history.groupBy(*keys).agg(F.max("FECHA").alias("__end"))
    d = history.join(last, keys).withColumn("__ago", F.datediff("__end", "FECHA")).where(F.col("__ago") < 2 * max(windows)).withColumn("__x", ~is_christmas("FECHA"))
    aggs = []
    tiers = {"a": (1, True), "b": (2, True), "c": (1, False)}
    for n in windows:
        for tier, (times, clean) in tiers.items():
            inside = (F.col("__ago") < n * times) & (F.col("__x") if clean else F.lit(True))
            x = F.when(inside, F.col(value))
            aggs += [F.sum(inside.cast("int")).alias(f"__n{n}{tier}")] + [f(x).alias(f"__{s}{n}{tier}") for s, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    lag1 = F.max_by(value, "FECHA").alias("__lag1")
    g = d.groupBy(*keys).agg(lag1, *aggs)
    out: dict[str, Column] = {}
    before: dict[str, Column] = {"mean": F.col("__lag1"), "std": F.lit(0.0), "min": F.col("__lag1"), "max": F.col("__lag1")}
    for n in windows:
        enough = F.col(f"__n{n}a") >= max(3, n // 2)
        some = F.col(f"__n{n}b") >= 3
        for s in ("mean", "std", "min", "max"):
            got = F.when(enough, F.col(f"__{s}{n}a")).when(some, F.col(f"__{s}{n}b")).otherwise(F.col(f"__{s}{n}c"))
            out[f"total_rolling_{s}_{n}d"] = before[s] = F.coalesce(got, before[s])
    return g.select(*keys, *[c.alias(k) for k, c in out.items()])


def days_since_holiday(targets: DataFrame, history: DataFrame, keys: list[str], holiday: str = "es_festivo", most: int = 30) -> DataFrame:
    """Calendar days since the last historical holiday before the target, at most `most`.  The history's
    holidays end before the horizon, so their latest is the last for every target day."""
    last = history.where(F.col(holiday)).groupBy(*keys).agg(F.max("FECHA").alias("__h"))
    return targets.join(last, keys, "left").withColumn("days_since_holiday", F.least(F.lit(most), F.coalesce(F.datediff("FECHA", "__h"), F.lit(most)))).drop("__h")


def climate_normals(weather: DataFrame, keys: list[str], defaults: dict[str, float] = CLIMATE_DEFAULTS) -> DataFrame:
    """(keys, month, means) for all twelve months of each key; defaults where a month has no data, or a mean of 0."""
    cols = list(defaults)
    means = weather.groupBy(*keys, F.month("FECHA").alias("month")).agg(*[F.avg(c).alias(c) for c in cols])
    grid = weather.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    d = grid.join(means, [*keys, "month"], "left")
    return d.select(*keys, "month", *[F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(defaults[c])).alias(c) for c in cols])


def climate_for(targets: DataFrame, weather: DataFrame, keys: list[str], defaults: dict[str, float] = CLIMATE_DEFAULTS) -> DataFrame:
    """Each target day's weather: the real one where it is known, the month's normals where not."""
    cols = list(defaults)
    real = weather.select(*keys, "FECHA", *[F.col(c).alias(f"__r_{c}") for c in cols], F.lit("real").alias("__src"))
    d = targets.withColumn("__m", F.month("FECHA")).join(real, [*keys, "FECHA"], "left").join(climate_normals(weather, keys, defaults).withColumnRenamed("month", "__m"), [*keys, "__m"], "left")
    d = d.withColumns({c: F.coalesce(f"__r_{c}", c, F.lit(defaults[c])) for c in cols}).withColumn("climate_source", F.coalesce("__src", F.lit("normals")))
    return d.drop("__m", "__src", *[f"__r_{c}" for c in cols])


def serving_weather(df: DataFrame) -> DataFrame:
    """The model's weather columns when serving: the lag columns hold the same day's weather, the rain lag the day's sum."""
    d = df.withColumns({"temp_lag1d": F.coalesce("temp_mean", F.lit(22.0)), "humidity_lag1d": F.coalesce("humidity_mean", F.lit(70.0)), "wind_speed_lag1d": F.coalesce("wind_speed_mean", F.lit(2.0)), "rain_lag1d": F.coalesce("rain_sum", F.lit(0.0))})
    return d.withColumns({"is_rainy_day": flag(F.col("rain_lag1d") > 1.0), "temp_x_is_weekend": F.col("temp_lag1d") * F.col("is_weekend"), "temp_x_is_festivo": F.col("temp_lag1d") * F.col("is_festivo"), "humidity_x_is_weekend": F.col("humidity_lag1d") * F.col("is_weekend")})


def lagged(targets: DataFrame, history: DataFrame, keys: list[str], back: Column, names: dict[str, str]) -> DataFrame:
    """as_of on the date `back`: names maps a history column to the new one."""
    d = targets.withColumn("__back", back)
    got = as_of(d, history, keys, "__back", list(names))
    return got.withColumnsRenamed(names).drop("__back")


def as_of_table(days: DataFrame, history: DataFrame, keys: list[str], asks: dict[str, Column], values: list[str]) -> DataFrame:
    """(keys, FECHA, {ask}_{value}): many as-of lookups for each day at once.  All asked dates go through one
    as_of as rows, and come back as columns, so the plan doesn't grow with their number."""
    long = days.select(*keys, "FECHA", F.explode(F.array(*[F.struct(F.lit(n).alias("ask"), c.alias("at")) for n, c in asks.items()])).alias("__q")).select(*keys, "FECHA", "__q.ask", "__q.at")
    got = as_of(long, history, keys, "at", values)
    return got.groupBy(*keys, "FECHA").agg(*[F.max(F.when(F.col("ask") == n, F.col(v))).alias(f"{n}_{v}") for n in asks for v in values])


def same_day_means(days: DataFrame, history: DataFrame, keys: list[str], value: str = "TOTAL") -> DataFrame:
    """(keys, FECHA, same_day_mean): the mean of earlier days of the same month-day."""
    past = history.select(*keys, mmdd("FECHA").alias("__md"), F.col("FECHA").alias("__h"), F.col(value).alias("__v"))
    j = days.select(*keys, "FECHA", mmdd("FECHA").alias("__md")).join(past, [*keys, "__md"]).where(F.col("__h") < F.col("FECHA"))
    return j.groupBy(*keys, "FECHA").agg(F.avg("__v").alias("same_day_mean"))


def serving_lags(days: DataFrame, history: DataFrame, keys: list[str], years: tuple[int, ...] = (1, 2, 3), last_resort: bool = True) -> DataFrame:
    """(keys, FECHA, lags) when serving: as-of values 1, 7 and 14 days back, of the peak hours too; and by year the
    as-of value n years before; where that is 0, the mean of earlier days of that month-day, else the as-of
    value 365 n days before, else total_lag_1d (null, without the last resort)."""
    peaks = [p for p in ("P8", "P12", "P18", "P20") if p in history.columns]
    asks = {f"b{n}": F.date_sub("FECHA", n) for n in (1, 7, 14)} | {f"y{n}": F.add_months("FECHA", -12 * n) for n in years} | {f"d{n}": F.date_sub("FECHA", 365 * n) for n in years}
    d = as_of_table(days, history.select(*keys, "FECHA", "TOTAL", *peaks), keys, asks, ["TOTAL", *peaks])
    d = d.join(same_day_means(days, history, keys), [*keys, "FECHA"], "left")
    out = {f"total_lag_{n}d": F.col(f"b{n}_TOTAL") for n in (1, 7, 14)} | {f"{p.lower()}_lag_{n}d": F.col(f"b{n}_{p}") for p in peaks for n in (1, 7)}
    zero = F.lit(0.0)
    for n in years:
        out[f"total_lag_{n}y"] = F.when(F.col(f"y{n}_TOTAL") != 0, F.col(f"y{n}_TOTAL")).otherwise(F.coalesce("same_day_mean", F.nullif(f"d{n}_TOTAL", zero), *(["b1_TOTAL"] if last_resort else [])))
    return d.select(*keys, "FECHA", *[c.alias(n) for n, c in out.items()])


def day_change() -> dict[str, Column]:
    """The day change when serving: total_lag_1d less total_lag_7d, plain and in percent."""
    change = F.col("total_lag_1d") - F.col("total_lag_7d")
    return {"total_day_change": change, "total_day_change_pct": F.coalesce(F.try_divide(change * 100, F.col("total_lag_7d")), F.lit(0.0))}


def serving_features(history: DataFrame, weather: DataFrame, holidays: DataFrame, keys: list[str], n: int = 30, last_resort: bool = True) -> DataFrame:
    """One row for each key and horizon day with everything a model asks for, in one job.  Lags are by date and
    as of; rolling statistics end on the last real day; is_festivo is the holiday calendar's."""
    days = horizon(history, n, keys)
    t = holiday_flags(days, holidays, keys).drop("festivo_nombre")
    t = season_features(cyclic_features(calendar_features(t, festivo=F.col("es_festivo")), mode="serve"))
    t = days_since_holiday(t, holiday_flags(history.select(*keys, "FECHA"), holidays, keys), keys)
    t = t.join(serving_lags(days, history, keys, last_resort=last_resort), [*keys, "FECHA"], "left").join(anchored_rolling(history, keys), keys, "left")
    return interaction_features(serving_weather(climate_for(t.withColumns(day_change()), weather, keys)))


def adjust(df: DataFrame, predicted: str = "demanda_predicha") -> DataFrame:
    """The prediction drawn to last year's value on special days: 0.70 of it on very special ones, 0.60 on other
    holidays and on weekends in Christmas season, where last year's value is positive."""
    weight = F.when(mmdd("FECHA").isin(*VERY_SPECIAL), W_VERY_SPECIAL).when(F.col("es_festivo"), W_SPECIAL).when(is_christmas("FECHA") & (F.weekday("FECHA") >= 5), W_SPECIAL)
    apply = weight.isNotNull() & (F.col("total_lag_1y") > 0)
    return df.withColumns({"predicted_raw": F.col(predicted), "adjusted": F.coalesce(apply, F.lit(False)), predicted: F.when(apply, weight * F.col("total_lag_1y") + (1 - weight) * F.col(predicted)).otherwise(F.col(predicted))})


def forecast_direct(features: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every horizon day at once, for a model without lags of the target.  `score` adds demanda_predicha."""
    return adjust(score(features))


#: Days that a recursive forecast's state reaches back, and the longest horizon: last year's days are then history.
REACH, LONGEST = 14, 364
_RECENT = {"total_lag_1d": 1, "total_lag_7d": 7, "total_lag_14d": 14}


def recursive_state(history: DataFrame, weather: DataFrame, holidays: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, __days, __recent, __made): one row a key with all that a forecast of n days needs.  __days holds what
    doesn't depend on forecasts, by horizon day: calendar, weather, annual lags (null where only yesterday's value
    is left), rolling statistics up to the last real day.  __recent holds the as-of totals of the last REACH days, the
    latest last; __made the forecasts, none yet.  The history is read here and nowhere later."""
    known = history.select(*keys, "FECHA", "TOTAL")
    t = serving_features(known, weather, holidays, keys, n, last_resort=False).drop(*_RECENT, *day_change(), "last_day")
    days = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("FECHA", *[c for c in t.columns if c not in (*keys, "FECHA")]))).alias("__days"))
    last = known.groupBy(*keys).agg(F.max("FECHA").alias("__end"))
    back = last.select(*keys, F.explode(F.sequence(F.date_sub("__end", REACH - 1), F.col("__end"))).alias("__at"))
    recent = as_of(back, known, keys, "__at", ["TOTAL"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "TOTAL")))["TOTAL"].alias("__recent"))
    return days.join(recent, keys).withColumn("__made", F.array().cast("array<double>"))


def recursive_features(state: DataFrame) -> DataFrame:
    """The features of each key's next day, beside its state."""
    d = state.withColumn("__day", F.get("__days", F.size("__made"))).select("*", "__day.*").drop("__day")
    d = d.withColumns({name: F.get("__recent", F.lit(REACH - back)) for name, back in _RECENT.items()})
    years = [c for c in d.columns if c.startswith("total_lag_") and c.endswith("y")]
    return d.withColumns({c: F.coalesce(c, "total_lag_1d") for c in years}).withColumns(day_change())


def forecast_recursive(history: DataFrame, weather: DataFrame, holidays: DataFrame, keys: list[str], n: int, score: Callable[[DataFrame], DataFrame], every: int = 1) -> DataFrame:
    """(keys, FECHA, demanda_predicha) of the n days after each key's last one (LONGEST at most), day by day, for a model
    whose lags may be forecasts.  `score` adds demanda_predicha and keeps the other columns.

    All keys move on together from one bounded row a key (recursive_state): a step is a projection without a shuffle, join
    or scan of the history, whose cost doesn't depend on the history.  Every `every` steps lineage ends in a checkpoint() in
    spark.checkpoint.dir (a local session without one gets a folder of its own).  As in the direct forecast, rolling
    statistics and the days since a holiday end with the real history.  An empty history gives no row."""
    if n > LONGEST:
        raise ValueError(f"a recursive forecast takes {LONGEST} days at most")
    scratch(history.sparkSession)
    state = recursive_state(history, weather, holidays, keys, n).checkpoint()
    cols = state.columns
    for k in range(n):
        state = adjust(score(recursive_features(state))).select(
            *[c for c in cols if c not in ("__recent", "__made")],
            F.concat(F.slice("__recent", 2, REACH - 1), F.array("demanda_predicha")).alias("__recent"), F.concat("__made", F.array("demanda_predicha")).alias("__made"),
        )
        if (k + 1) % every == 0 or k == n - 1:
            state = state.checkpoint()
    made = F.explode(F.arrays_zip(F.col("__days")["FECHA"].alias("FECHA"), F.col("__made").alias("demanda_predicha"))).alias("x")
    return state.select(*keys, made).select(*keys, "x.*")


def apply_offset(df: DataFrame, offset: float | None, total: str = "demanda_predicha", hours: str = "hours") -> DataFrame:
    """Total and hours times the offset, where one is given that is positive and not 1."""
    if offset is None or offset <= 0 or offset == 1:
        return df
    out = df.withColumn(total, F.col(total) * offset)
    return out.withColumn(hours, scaled(F.col(hours), F.lit(float(offset)))) if hours in df.columns else out


def output_rows(df: DataFrame, keys: list[str], hours: list[str] = ()) -> DataFrame:
    """The forecast as it is handed out: weekday name, two decimals, a method where none is set."""
    method = F.coalesce(F.col("metodo") if "metodo" in df.columns else F.lit(None).cast("string"), F.when(F.col("es_festivo"), "special").otherwise("normal"))
    return df.select(*keys, F.col("FECHA").alias("fecha"), weekday_name("FECHA").alias("dia_semana"), F.round("demanda_predicha", 2).alias("demanda_predicha"), "es_festivo", method.alias("metodo_desagregacion"), *[F.round(h, 2).alias(h) for h in hours])


def summary(df: DataFrame, keys: list[str], date: str = "fecha", value: str = "demanda_predicha", holiday: str = "es_festivo") -> DataFrame:
    weekend = F.weekday(F.col(date)) >= 5
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        n(~weekend & ~F.col(holiday)).alias("working_days"), n(weekend & ~F.col(holiday)).alias("weekend_days"), n(F.col(holiday)).alias("holidays"),
    )


def backtest_frame(history: DataFrame, keys: list[str], days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(history up to `days` before each key's last day, the actual days after): a hold-out of the last days."""
    last = history.groupBy(*keys).agg(F.max("FECHA").alias("__end"))
    d = history.join(last, keys)
    return d.where(F.col("FECHA") <= F.date_sub("__end", days)).drop("__end"), d.where(F.col("FECHA") >= F.date_sub("__end", days - 1)).drop("__end")


def with_actuals(forecast: DataFrame, actual: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The forecast joined to actual totals by key and date: inner to measure, left to show."""
    return forecast.join(actual.select(*keys, "FECHA", F.col("TOTAL").alias("real")), [*keys, "FECHA"], how)
