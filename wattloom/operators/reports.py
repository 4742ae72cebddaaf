"""Tables behind the reports: profiles, weeks, long hours, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.expressions import pct, row_sum
from wattloom.schema import HOURS


def hour_profile(df: DataFrame, by: list[str], hours: list[str] = HOURS) -> DataFrame:
    """(by, periodo, mean): the mean of each hour by group, in long form.  24 averages, then unpivot."""
    m = df.groupBy(*by).agg(*[F.avg(h).alias(h) for h in hours])
    return m.unpivot(by, hours, "periodo", "mean").withColumn("periodo", F.expr("cast(substring(periodo, 2) as int)"))


def of_categories(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isin(*values))


def weekly_means(df: DataFrame, keys: list[str], day_type: str = "TIPO DIA") -> DataFrame:
    """Mean TOTAL by calendar year, ISO week and day type (the pair is kept as it is at the turn of the year)."""
    return df.groupBy(*keys, F.year("FECHA").alias("year"), F.weekofyear("FECHA").alias("week"), day_type).agg(F.avg("TOTAL").alias("mean_total"))


def week_hour_matrix(df: DataFrame, keys: list[str], hours: list[str] = HOURS) -> DataFrame:
    """A row for each week, a column for each hour."""
    long = hour_profile(df.withColumn("week", F.weekofyear("FECHA")), [*keys, "week"], hours)
    return long.groupBy(*keys, "week").pivot("periodo", list(range(1, len(hours) + 1))).agg(F.first("mean"))


def compare_weeks(df: DataFrame, weeks: list[int], keys: list[str]) -> DataFrame:
    d = df.withColumn("week", F.weekofyear("FECHA"))
    return hour_profile(of_categories(d, "week", weeks), [*keys, "week"])


def weekly_forecast(df: DataFrame, keys: list[str], value: str = "demanda_predicha") -> DataFrame:
    return df.groupBy(*keys, F.weekofyear("FECHA").alias("week")).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.min("FECHA").alias("first_day"))


def weekday_means(df: DataFrame, keys: list[str], value: str = "TOTAL") -> DataFrame:
    return df.groupBy(*keys, F.weekday("FECHA").alias("dow")).agg(F.avg(value).alias("mean")).orderBy(*keys, "dow")


def to_hourly(df: DataFrame, keys: list[str], tipo: str, hours: list[str] = HOURS, date: str = "FECHA") -> DataFrame:
    """A row for each hour that has a value: keys, fecha_hora, periodo, demanda_horaria, tipo.  Hour 1 is midnight."""
    d = df.select(*keys, date, *hours).unpivot([*keys, date], hours, "periodo", "demanda_horaria").where("demanda_horaria is not null")
    d = d.withColumn("periodo", F.expr("cast(substring(periodo, 2) as int)"))
    return d.select(*keys, F.timestamp_add("HOUR", F.col("periodo") - 1, F.col(date).cast("timestamp_ntz")).alias("fecha_hora"), "periodo", "demanda_horaria", F.lit(tipo).alias("tipo"))


def history_and_forecast(history: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Both as hours with a tag."""
    return to_hourly(history, keys, "historico").unionByName(to_hourly(forecast, keys, "prediccion"))


def side_by_side(curve: DataFrame, history: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Left join of two series on key and time: the curve's rows all stay."""
    return curve.join(history.select(*keys, at, F.col(value).alias(f"{value}_historico")), [*keys, at], "left")


def error_matrix(pred: DataFrame, real: DataFrame, keys: list[str], hours: list[str] = HOURS) -> DataFrame:
    """(keys, FECHA, periodo, error, error_pct) of each hour: predicted minus real."""
    p = pred.select(*keys, "FECHA", *hours).unpivot([*keys, "FECHA"], hours, "periodo", "pred")
    r = real.select(*keys, "FECHA", *hours).unpivot([*keys, "FECHA"], hours, "periodo", "real")
    j = p.join(r, [*keys, "FECHA", "periodo"])
    e = F.col("pred") - F.col("real")
    return j.select(*keys, "FECHA", F.expr("cast(substring(periodo, 2) as int)").alias("periodo"), e.alias("error"), pct(e, F.col("real")).alias("error_pct"))


def daily_history(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, FECHA, TOTAL) of a range in order; the sum of the hours where there is no TOTAL column."""
    total = F.col("TOTAL") if "TOTAL" in df.columns else row_sum(HOURS)
    return df.where(F.col("FECHA").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).select(*keys, "FECHA", total.alias("TOTAL")).orderBy(*keys, "FECHA")


def last_rows(df: DataFrame, n: int, keys: list[str], date: str = "FECHA") -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(date).desc()))).where(F.col("__n") <= n).drop("__n")


def last_days(df: DataFrame, n: int, keys: list[str], date: str = "FECHA") -> DataFrame:
    """The last n calendar days of each key."""
    last = df.groupBy(*keys).agg(F.max(date).alias("__end"))
    return df.join(last, keys).where(F.col(date) > F.date_sub("__end", n)).drop("__end")
