"""Cleaning and quality reports.  Statistics are one pass each and pre-aggregate; no row leaves its task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.calendar import day_class
from wattloom.functions.expressions import pct, row_sum, to_date, to_double
from wattloom.operators.quantiles import exact_quantiles
from wattloom.schema import DEMAND_COLUMNS, HOURS, WEATHER_DAILY

#: Limits of the quality checks.
MAX_MISSING_PCT, OUTLIER_SIGMA, TOTAL_TOLERANCE_PCT, MAX_OUTLIER_PCT = 5.0, 4.0, 1.0, 1.0
WEATHER_RANGES = {"temp_mean": (5.0, 40.0), "humidity_mean": (0.0, 100.0), "wind_speed_mean": (0.0, 50.0), "rain_sum": (0.0, 300.0)}
CRITICAL_DEMAND, CRITICAL_WEATHER = ["FECHA", "UCP", "VARIABLE", *HOURS], ["FECHA", "temp_mean", "humidity_mean"]


def keep_expected(df: DataFrame, expected: list[str]) -> DataFrame:
    return df.select([F.col(f"`{c}`") for c in expected if c in df.columns])


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "Unnamed" in c])


def schema_alerts(df: DataFrame, expected: list[str]) -> DataFrame:
    """One ERROR row for each expected column that is missing; with any, the table doesn't pass."""
    rows = [("ERROR", "schema", c, "missing column") for c in expected if c not in df.columns]
    return df.sparkSession.createDataFrame(rows, "level string, check string, column string, message string")


def coerce(df: DataFrame, numbers: list[str], dates: list[str] = ("FECHA",)) -> DataFrame:
    """Numbers and dates that don't parse become null."""
    return df.withColumns({**{c: to_double(c) for c in numbers if c in df.columns}, **{c: to_date(c) for c in dates if c in df.columns}})


def drop_incomplete(df: DataFrame, critical: list[str]) -> DataFrame:
    return df.dropna(subset=[c for c in critical if c in df.columns])


def event_day(df: DataFrame, name: str = "EVENTO") -> DataFrame:
    """The event column, as 0 where it is absent, empty or null."""
    return df.withColumn(name, F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit("0")) if name in df.columns else F.lit("0"))


def total_gap(hours: list[str] = HOURS, total: str = "TOTAL") -> Column:
    """How far the total is from the sum of its hours, in percent of the total."""
    return F.abs(pct(F.col(total) - row_sum(hours), F.col(total)))


def clean_demand(df: DataFrame) -> DataFrame:
    """The whole cleaning of daily demand: expected columns, types, day class, event day, complete rows only."""
    d = coerce(keep_expected(drop_unnamed(df), DEMAND_COLUMNS), [*HOURS, "TOTAL"])
    d = d.withColumn("TIPO DIA", day_class("TIPO DIA")) if "TIPO DIA" in d.columns else d
    return drop_incomplete(event_day(d), CRITICAL_DEMAND)


def clean_weather(df: DataFrame) -> DataFrame:
    return drop_incomplete(coerce(df, [c for c in WEATHER_DAILY if c != "FECHA"]), CRITICAL_WEATHER)


def null_percentages(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, column, null_pct, status) in one pass over all columns."""
    one = df.groupBy(*keys).agg(*[(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100).alias(c) for c in cols])
    long = one.unpivot(list(keys), cols, "column", "null_pct")
    return long.withColumn("status", F.when(F.col("null_pct") > MAX_MISSING_PCT, "ALERT").otherwise("OK"))


def removed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before, removed rows and their share for each key, with an alert above the limit."""
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after"))
    out = b.join(a, keys, "left").withColumn("removed", F.col("rows_before") - F.coalesce("rows_after", F.lit(0)))
    return out.select(*keys, "rows_before", "removed", pct(F.col("removed"), F.col("rows_before")).alias("removed_pct")).withColumn("alert", F.col("removed_pct") > MAX_MISSING_PCT)


def sigma_outliers(df: DataFrame, cols: list[str], keys: list[str], sigma: float = OUTLIER_SIGMA) -> DataFrame:
    """(keys, column, outliers): values beyond mean +- sigma * std, counted and not removed.  The second
    pass carries one row of statistics for each key, not a window over it."""
    stats = df.groupBy(*keys).agg(*[f(F.col(c)).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    j = df.select(*keys, *cols).join(stats, keys)
    n = j.groupBy(*keys).agg(*[F.coalesce(F.sum((F.abs(F.col(c) - F.col(f"__m_{c}")) > sigma * F.col(f"__s_{c}")).cast("long")), F.lit(0)).alias(c) for c in cols])
    return n.unpivot(keys, cols, "column", "outliers")


def range_outliers(df: DataFrame, keys: list[str], ranges: dict[str, tuple[float, float]] = WEATHER_RANGES) -> DataFrame:
    cols = [c for c in ranges if c in df.columns]
    n = df.groupBy(*keys).agg(*[F.coalesce(F.sum(((F.col(c) < ranges[c][0]) | (F.col(c) > ranges[c][1])).cast("long")), F.lit(0)).alias(c) for c in cols])
    return n.unpivot(keys, cols, "column", "outliers")


def iqr_outliers(df: DataFrame, col: str, keys: list[str], factor: float = 1.5, approximate: bool = False, spread: bool = False) -> DataFrame:
    """Quartiles (linear), fences, count and share beyond them, alert above the limit.  `approximate` bounds
    the memory of huge groups; `spread` does so with exact quartiles, in one more pass."""
    if spread:
        quartiles = exact_quantiles(df, col, keys, {"q1": 0.25, "q3": 0.75}).drop("n")
        return _beyond_fences(df, quartiles, col, keys, factor)
    q = F.percentile_approx(col, F.array(F.lit(0.25), F.lit(0.75)), F.lit(10000)) if approximate else F.percentile(col, F.array(F.lit(0.25), F.lit(0.75)))
    fences = df.groupBy(*keys).agg(q.alias("q")).select(*keys, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    return _beyond_fences(df, fences, col, keys, factor)


def _beyond_fences(df: DataFrame, fences: DataFrame, col: str, keys: list[str], factor: float) -> DataFrame:
    j = df.select(*keys, col).join(fences, keys)
    low, high = F.col("q1") - factor * (F.col("q3") - F.col("q1")), F.col("q3") + factor * (F.col("q3") - F.col("q1"))
    out = j.groupBy(*keys, "q1", "q3").agg(F.count(col).alias("n"), F.coalesce(F.sum(((F.col(col) < low) | (F.col(col) > high)).cast("long")), F.lit(0)).alias("outliers"))
    return out.withColumn("outlier_pct", pct(F.col("outliers"), F.col("n"))).withColumn("alert", F.col("outlier_pct") > MAX_OUTLIER_PCT)


def inconsistent_totals(df: DataFrame, keys: list[str], hours: list[str] = HOURS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((total_gap(hours) > TOTAL_TOLERANCE_PCT).cast("long")), F.lit(0)).alias("inconsistent"))


def final_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min("FECHA").alias("first_day"), F.max("FECHA").alias("last_day"), F.countDistinct("UCP").alias("units"), F.countDistinct("VARIABLE").alias("variables"))


def day_type_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "TIPO DIA").agg(F.count(F.lit(1)).alias("days"))


def alert_rollup(alerts: DataFrame) -> DataFrame:
    """Alert counts by level, by type, by severity of a (level, check) pair and in all, in one pass."""
    return alerts.groupingSets([["level"], ["check"], ["level", "check"], []], "level", "check").agg(F.count(F.lit(1)).alias("alerts"), F.grouping_id().cast("long").alias("grouping"))


def append_demand(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union by name, one row for each key and date: an existing row wins over a new one."""
    both = old.withColumn("__rank", F.lit(0)).unionByName(new.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy(*keys, "FECHA").orderBy("__rank")
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__rank", "__n")


def append_weather(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union without full duplicates."""
    return old.unionByName(new).distinct()


def next_start(df: DataFrame, keys: list[str], all_keys: DataFrame | None = None, date: str = "FECHA", default: str = "2005-11-06") -> DataFrame:
    """The last day that each key has, from which an increment starts; the default for a key without rows."""
    last = df.groupBy(*keys).agg(F.max(date).alias("__last"))
    base = last if all_keys is None else all_keys.select(*keys).distinct().join(last, keys, "left")
    return base.select(*keys, F.coalesce("__last", F.to_date(F.lit(default))).alias("start"))


def weather_daily(hourly: DataFrame, keys: list[str], std_default: float = 2.5) -> DataFrame:
    """Hourly weather to one row a day; a day with one hour has temp_std = std_default."""
    agg = [
        F.avg("p_t").alias("temp_mean"), F.min("p_t").alias("temp_min"), F.max("p_t").alias("temp_max"), F.coalesce(F.stddev_samp("p_t"), F.lit(std_default)).alias("temp_std"),
        F.avg("p_h").alias("humidity_mean"), F.min("p_h").alias("humidity_min"), F.max("p_h").alias("humidity_max"), F.avg("p_v").alias("wind_speed_mean"), F.max("p_v").alias("wind_speed_max"),
        F.avg("p_i").alias("rain_mean"), F.sum("p_i").alias("rain_sum"),
    ]
    return hourly.groupBy(*keys, F.col("fecha").alias("FECHA")).agg(*agg)


