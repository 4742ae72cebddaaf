"""Training features: lags, rolling statistics, seasons, weather, interactions.

Every window has the one specification partitionBy(keys).orderBy(date), so that Spark plans one exchange
and one sort for all of them; what has another grouping (same month-day, same date a year before) is
aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.calendar import calendar_features, cyclic_features, is_christmas, mmdd, season_features
from wattloom.functions.expressions import flag, pct
from wattloom.schema import KEYS

#: Lags and windows, in rows.
LAGS, YEARS, ROLLING = [1, 7, 14], [1, 2, 3], [7, 14, 28]
PEAK_HOURS, PEAK_LAGS = ["P8", "P12", "P18", "P20"], [1, 7]
WEATHER_LAGS = {"temp_mean": "temp_lag1d", "humidity_mean": "humidity_lag1d", "wind_speed_mean": "wind_speed_lag1d", "rain_mean": "rain_lag1d"}
#: Columns that leak the target when a model forecasts recursively.
DIRECT_LAGS = ["total_lag_1d", "total_lag_7d", "total_lag_14d", "p8_lag_1d", "p8_lag_7d", "p12_lag_1d", "p12_lag_7d", "p18_lag_1d", "p18_lag_7d", "p20_lag_1d", "p20_lag_7d", "total_day_change", "total_day_change_pct"]


def by_day(keys: list[str], date: str = "FECHA"):
    return Window.partitionBy(*keys).orderBy(date)


def row_lags(df: DataFrame, keys: list[str], value: str = "TOTAL", lags: list[int] = LAGS, prefix: str | None = None) -> DataFrame:
    """Value so many rows before; not days: gaps in the series count as nothing."""
    prefix = prefix or value.lower()
    return df.withColumns({f"{prefix}_lag_{n}d": F.lag(value, n).over(by_day(keys)) for n in lags})


def annual_lags(df: DataFrame, keys: list[str], value: str = "TOTAL", years: list[int] = YEARS) -> DataFrame:
    """Value on the same date 1, 2 and 3 years before (29 February goes to the 28th).  Gaps take the mean of
    that lag over the same month-day, then the mean value of the key.  Of a date that
    repeats the largest value counts, so that the join can't fan out.  All years are one exploded lookup and one join."""
    name = lambda n: f"{value.lower()}_lag_{n}y"
    past = df.groupBy(*keys, "FECHA").agg(F.max(value).alias("__v"))
    looks = df.select(*keys, "FECHA").distinct().select(*keys, "FECHA", F.explode(F.array(*[F.lit(n) for n in years])).alias("__n")).withColumn("__at", F.add_months("FECHA", -12 * F.col("__n")))
    found = looks.join(past.withColumnRenamed("FECHA", "__at"), [*keys, "__at"]).groupBy(*keys, "FECHA").pivot("__n", years).agg(F.first("__v"))
    found = found.select(*keys, "FECHA", *[F.col(str(n)).alias(name(n)) for n in years])
    d = df.join(found, [*keys, "FECHA"], "left").withColumn("__md", mmdd("FECHA"))
    by_md = d.groupBy(*keys, "__md").agg(*[F.avg(name(n)).alias(f"__a{n}") for n in years])
    overall = df.groupBy(*keys).agg(F.avg(value).alias("__all"))
    d = d.join(by_md, [*keys, "__md"], "left").join(overall, keys, "left")
    d = d.withColumns({name(n): F.coalesce(name(n), f"__a{n}", "__all") for n in years})
    return d.drop("__md", "__all", *[f"__a{n}" for n in years])


def rolling_stats(df: DataFrame, keys: list[str], value: str = "TOTAL", windows: list[int] = ROLLING, shift: int = 0) -> DataFrame:
    """Mean, sample std, min and max over the last w rows, the current one included (shift=1 leaves it out).
    Christmas days don't count; with fewer than w // 2 values left the plain window stands in."""
    clean = F.when(~is_christmas("FECHA"), F.col(value))
    out = {}
    for w in windows:
        over = by_day(keys).rowsBetween(-(w - 1) - shift, -shift)
        enough = F.count(clean).over(over) >= max(1, w // 2)
        for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"{value.lower()}_rolling_{n}_{w}d"] = F.coalesce(F.when(enough, f(clean).over(over)), f(F.col(value)).over(over))
    return df.withColumns(out)


def day_change(df: DataFrame, keys: list[str], value: str = "TOTAL") -> DataFrame:
    """Change to the row before, plain and in percent; the latter carries the last known value over gaps and
    is null on a base of 0."""
    w = by_day(keys)
    known = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("__known", known).withColumn("__before", F.lag("__known").over(w))
    return d.withColumns({f"{value.lower()}_day_change": F.col(value) - F.lag(value).over(w), f"{value.lower()}_day_change_pct": pct(F.col("__known") - F.col("__before"), F.col("__before"))}).drop("__known", "__before")


def days_since_holiday(df: DataFrame, keys: list[str], holiday: str = "is_festivo", most: int = 30) -> DataFrame:
    """Rows since the last holiday: 0 on it, `most` before the first and beyond."""
    w = by_day(keys)
    d = df.withColumn("__n", F.row_number().over(w))
    last = F.last(F.when(F.col(holiday) == 1, F.col("__n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("days_since_holiday", F.least(F.lit(most), F.coalesce(F.col("__n") - last, F.lit(most)))).drop("__n")


def demand_features(df: DataFrame, keys: list[str], shift: int = 0) -> DataFrame:
    d = rolling_stats(row_lags(df, keys), keys, shift=shift)
    for p in PEAK_HOURS:
        if p in df.columns:
            d = row_lags(d, keys, p, PEAK_LAGS)
    return annual_lags(day_change(d, keys), keys)


def weather_features(power: DataFrame, weather: DataFrame, keys: list[str]) -> DataFrame:
    """Weather of the row before, and today's crossed with the calendar.  Columns that both sides have keep
    the demand side's; the daily weather itself isn't kept."""
    extra = [c for c in weather.columns if c not in (*keys, "FECHA") and c not in power.columns]
    d = power.join(weather.select(*keys, "FECHA", *extra), [*keys, "FECHA"], "left")
    w = by_day(keys)
    out: dict[str, Column] = {new: F.lag(c).over(w) for c, new in WEATHER_LAGS.items()}
    out |= {
        "temp_x_is_weekend": F.col("temp_mean") * F.col("is_weekend"), "temp_x_is_festivo": F.col("temp_mean") * F.col("is_festivo"), "humidity_x_is_weekend": F.col("humidity_mean") * F.col("is_weekend"),
        "is_rainy_day": flag(F.col("rain_sum") > 1.0),
    }
    return d.withColumns(out).drop(*extra)


def interaction_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"dayofweek_x_festivo": F.col("dayofweek") * F.col("is_festivo"), "month_x_festivo": F.col("month") * F.col("is_festivo"), "weekend_x_month": F.col("is_weekend") * F.col("month")})


def fill_forward(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The last known value, then 0."""
    w = by_day(keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0)) for c in cols})


def build_features(demand: DataFrame, weather: DataFrame | None = None, keys: list[str] = KEYS, shift: int = 0) -> DataFrame:
    """All training features of cleaned daily demand, for all keys in one job.  shift=1 keeps the target out
    of the rolling statistics, which by default contain it."""
    base = demand.columns
    d = cyclic_features(calendar_features(demand))
    d = days_since_holiday(season_features(demand_features(d, keys, shift)), keys)
    if weather is not None:
        d = weather_features(d, weather, keys)
    d = interaction_features(d)
    return fill_forward(d, keys, [c for c in d.columns if c not in (*base, "season")])


def feature_names(df: DataFrame, base: list[str], lag_free: bool = False) -> list[str]:
    """The model's columns; lag_free leaves out the direct lags."""
    return [c for c in df.columns if c not in base and c != "season" and not (lag_free and c in DIRECT_LAGS)]


def fill_zero(df: DataFrame, cols: list[str], target: str = "TOTAL") -> DataFrame:
    return df.where(F.col(target).isNotNull()).fillna(0, cols)


def fill_mean(df: DataFrame, cols: list[str], target: str = "TOTAL") -> DataFrame:
    """Null to the column's mean over finite values, then infinite to 0.  The means are one row, fetched first."""
    d = df.where(F.col(target).isNotNull()).withColumns({c: F.col(c).cast("double") for c in cols})
    means = d.agg(*[F.avg(F.when(F.abs(F.col(c)) < float("inf"), F.col(c))).alias(c) for c in cols]).first().asDict()
    return d.fillna({c: m for c, m in means.items() if m is not None}).replace([float("inf"), float("-inf")], [0.0, 0.0], cols)


#: Feature groups by what a name holds.
GROUPS = {"weather": ("temp", "humid", "wind", "rain"), "demand": ("total_", "p8_", "p12_", "p18_", "p20_"), "season": ("season", "january", "december", "week_of_month", "since_holiday"), "interaction": ("_x_",)}


def feature_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(group, features, nulls): how many columns a group has and how many nulls these hold, in one pass."""
    of = lambda c: next((g for g in ("interaction", "weather", "demand", "season") if any(x in c for x in GROUPS[g])), "calendar")
    nulls = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in names]).unpivot([], names, "column", "nulls")
    groups = F.create_map(*[F.lit(x) for c in names for x in (c, of(c))])
    return nulls.groupBy(F.element_at(groups, F.col("column")).alias("group")).agg(F.count(F.lit(1)).alias("features"), F.sum("nulls").alias("nulls"))
