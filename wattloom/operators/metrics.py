"""Error metrics as grouped aggregates: algebraic sums and one median, whatever the grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.expressions import pct

#: Limits of the regulator, in percent and hours a month.
MAX_MAPE, MAX_DAILY, MAX_HOURS = 5.0, 5.0, 60
EPS = 1e-10
INF = float("inf")


def with_errors(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Signed and absolute error, plain and in percent of y; percent is null on y = 0."""
    e = F.col(yhat) - F.col(y)
    return df.withColumns({"error": e, "abs_error": F.abs(e), "error_pct": pct(e, F.col(y)), "abs_error_pct": F.abs(pct(e, F.col(y)))})


def mape(y: str, yhat: str) -> Column:
    """Mean absolute percent error over |y| > 1e-10; infinite if there is none."""
    ok = F.abs(F.col(y)) > EPS
    return F.coalesce(F.avg(F.when(ok, F.abs(F.try_divide(F.col(y) - F.col(yhat), F.col(y)))) * 100), F.lit(INF))


def correlation(y: str, yhat: str) -> Column:
    """Pearson's r over pairs without null; 0 for fewer than two, null without variance."""
    both = F.col(y).isNotNull() & F.col(yhat).isNotNull()
    a, b = F.when(both, F.col(y)), F.when(both, F.col(yhat))
    return F.when(F.count(a) < 2, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def error_metrics(df: DataFrame, y: str, yhat: str, by: list[str] = ()) -> DataFrame:
    """n, mae, rmse, r2, mape, correlation and rmape (mape / r; infinite where r isn't positive or mape is infinite)."""
    e = F.col(y) - F.col(yhat)
    n = F.count(e)
    out = df.groupBy(*by).agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.count(y) * F.var_pop(y))).alias("r2"),
        mape(y, yhat).alias("mape"), correlation(y, yhat).alias("r"),
    )
    rmape = F.when(F.col("r").isNull(), None).when((F.col("r") <= EPS) | (F.col("mape") == INF), F.lit(INF)).otherwise(F.try_divide(F.col("mape"), F.col("r")))
    return out.withColumn("rmape", rmape)


def regulation(df: DataFrame, y: str, yhat: str, by: list[str] = (), limit: float = MAX_MAPE) -> DataFrame:
    """Whether the mean error keeps the limit, and how many days do."""
    p = F.abs(pct(F.col(y) - F.col(yhat), F.col(y)))
    out = df.groupBy(*by).agg(mape(y, yhat).alias("mape"), F.count(F.lit(1)).alias("days"), F.coalesce(F.sum((p < limit).cast("long")), F.lit(0)).alias("days_ok"))
    return out.withColumns({"passes": F.col("mape") < limit, "compliance_pct": pct(F.col("days_ok"), F.col("days"))})


def error_distribution(df: DataFrame, y: str, yhat: str, by: list[str] = ()) -> DataFrame:
    e = F.col(yhat) - F.col(y)
    return df.groupBy(*by).agg(F.avg(e).alias("error_mean"), F.percentile(e, F.lit(0.5)).alias("error_median"), F.stddev_pop(e).alias("error_std"), F.max(e).alias("error_max"), F.min(e).alias("error_min"))


def error_shares(df: DataFrame, y: str, yhat: str, by: list[str] = (), limits: tuple[int, ...] = (5, 3, 1)) -> DataFrame:
    p = F.abs(pct(F.col(y) - F.col(yhat), F.col(y)))
    return df.groupBy(*by).agg(*[(F.avg((p < n).cast("double")) * 100).alias(f"under_{n}_pct") for n in limits])


def split_summary(df: DataFrame, y: str, yhat: str, by: list[str]) -> DataFrame:
    """MAPE, MAE, RMSE, bias and spread of the error for each split."""
    e = F.col(yhat) - F.col(y)
    return df.groupBy(*by).agg(F.count(e).alias("n"), mape(y, yhat).alias("mape"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("error_std"))


def histogram(df: DataFrame, col: str, by: list[str] = (), bins: int = 20) -> DataFrame:
    """Counts in equal bins between the least and the largest value of each group, both included."""
    ends = df.groupBy(*by).agg(F.min(col).alias("low"), F.max(col).alias("high"))
    j = df.select(*by, col).where(F.col(col).isNotNull())
    j = j.join(ends, list(by)) if by else j.join(F.broadcast(ends))  # one row
    k = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide((F.col(col) - F.col("low")) * bins, F.col("high") - F.col("low"))), F.lit(0))).cast("int")
    return j.groupBy(*by, k.alias("bin"), (F.col("low") + k * (F.col("high") - F.col("low")) / bins).alias("bin_low")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    q = [F.percentile(col, F.lit(p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), *q, F.max(col).alias("max"))


def worst_days(df: DataFrame, col: str, n: int = 10, by: list[str] = (), date: str = "FECHA") -> DataFrame:
    """The n largest, overall or for each key; ties by date."""
    if not by:
        return df.orderBy(F.col(col).desc_nulls_last(), date).limit(n)
    w = Window.partitionBy(*by).orderBy(F.col(col).desc_nulls_last(), date)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hourly_errors(df: DataFrame, real: str, pred: str) -> DataFrame:
    """For a day's two arrays of 24: MAE, RMSE, MAPE (hours of 0 left out), largest error, its hour (first on ties)
    and percent, hours over 5 %.  Array functions only: no shuffle."""
    e = F.transform(F.arrays_zip(F.col(real).alias("y"), F.col(pred).alias("p")), lambda x: F.struct(F.abs(x["p"] - x["y"]).alias("e"), F.abs(pct(x["p"] - x["y"], x["y"])).alias("p")))
    d = df.withColumn("__e", F.transform(e, lambda x: x["e"])).withColumn("__p", F.filter(F.transform(e, lambda x: x["p"]), lambda x: x.isNotNull()))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n, m = F.size("__e"), F.size("__p")
    return d.withColumns({
        "mae": F.try_divide(total(F.col("__e")), n), "rmse": F.sqrt(F.try_divide(total(F.transform("__e", lambda x: x * x)), n)), "mape": F.try_divide(total(F.col("__p")), m),
        "max_error": F.array_max("__e"), "max_error_hour": F.array_position("__e", F.array_max("__e")).cast("int"), "max_error_pct": F.array_max("__p"), "hours_over": F.size(F.filter("__p", lambda x: x > MAX_DAILY)),
    }).drop("__e", "__p")


def breakdown(df: DataFrame, dims: list[str], cols: tuple[str, ...] = ("mae", "rmse", "mape")) -> DataFrame:
    """Means by each dimension alone and overall, with the share of days, in one pass of grouping sets."""
    out = df.groupingSets([[d] for d in dims] + [[]], *dims).agg(F.count(F.lit(1)).alias("days"), *[F.avg(c).alias(c) for c in cols])
    return out.withColumn("share_pct", pct(F.col("days"), F.max("days").over(Window.partitionBy(F.lit(0)))))  # one row a value


def group_summary(df: DataFrame, by: list[str]) -> DataFrame:
    m = [f("mape").alias(f"mape_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))] + [f("mae").alias(f"mae_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    out = df.groupBy(*by).agg(*m, F.count(F.lit(1)).alias("days"))
    return out.select(*by, *[F.round(c, 2).alias(c) for c in out.columns if c not in (*by, "days")], "days")


def sum_validity(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Share of days whose hours add up, and the largest difference (columns sum_valid, sum_diff)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), (F.avg(F.col("sum_valid").cast("double")) * 100).alias("valid_pct"), F.max("sum_diff").alias("max_diff"))


def hours_over_limit(df: DataFrame, by: list[str], date: str = "FECHA") -> DataFrame:
    """Hours over 5 % by month, their share, and whether the month keeps the limit."""
    out = df.groupBy(*by, F.trunc(date, "month").alias("month")).agg(F.sum("hours_over").cast("long").alias("hours_over"), (F.count(F.lit(1)) * 24).alias("hours"))
    return out.withColumns({"over_pct": pct(F.col("hours_over"), F.col("hours")), "within_limit": F.col("hours_over") <= MAX_HOURS})


def consecutive_days(df: DataFrame, keys: list[str], error_pct: str = "abs_error_pct", limit: float = MAX_DAILY, date: str = "FECHA") -> DataFrame:
    """For each key whether two days in a row (row order) exceed the limit, and the second and later days of
    such runs with, before the first of all, the day it followed."""
    w = Window.partitionBy(*keys).orderBy(date)
    bad = F.coalesce(F.col(error_pct) > limit, F.lit(False))
    d = df.select(*keys, date, (bad & F.coalesce(F.lag(bad).over(w), F.lit(False))).alias("__f"), F.lag(date).over(w).alias("__before"))
    out = d.groupBy(*keys).agg(F.bool_or("__f").alias("consecutive"), F.array_sort(F.collect_list(F.when(F.col("__f"), F.col(date)))).alias("__days"), F.min_by("__before", F.when(F.col("__f"), F.col(date))).alias("__first"))
    return out.select(*keys, "consecutive", F.when(F.col("consecutive"), F.concat(F.array("__first"), F.col("__days"))).otherwise(F.col("__days")).alias("days"))


def retrain_decision(df: DataFrame) -> DataFrame:
    """From mape and consecutive: both, one or none of the two reasons, as text too."""
    high = F.col("mape") > MAX_MAPE
    reason = F.when(high & F.col("consecutive"), "ambos").when(F.col("consecutive"), "consecutivo").when(high, "mensual")
    return df.withColumns({"should_retrain": reason.isNotNull(), "reason": reason, "detail": F.when(reason.isNotNull(), F.format_string("%s: MAPE %.2f%%", reason, F.col("mape"))).otherwise(F.lit("none"))})


def grade(col: str = "mape") -> Column:
    return F.when(F.col(col) < 5, "excellent").when(F.col(col) < 10, "good").when(F.col(col) < 15, "acceptable").otherwise("poor")


def compare_methods(df: DataFrame, method: str = "method") -> DataFrame:
    """Mean MAPE of the special and the normal split, their grade, and whether special is over 1.5 times normal."""
    out = df.agg(F.avg("mape").alias("mape"), F.avg(F.when(F.col(method) == "special", F.col("mape"))).alias("mape_special"), F.avg(F.when(F.col(method) == "normal", F.col("mape"))).alias("mape_normal"))
    return out.withColumns({"grade": grade(), "special_worse": F.coalesce(F.col("mape_special") > 1.5 * F.col("mape_normal"), F.lit(False))})


def champion(scores: DataFrame, keys: list[str], criterion: str = "rmape", order: list[str] | None = None) -> DataFrame:
    """The best model of each key: least score, for r2 the largest; null and infinite scores never win, ties go
    to the model that comes first in `order`, or by name."""
    s = F.col(criterion)
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != INF)
    place = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model")), F.lit(0)) if order else F.col("model")
    w = Window.partitionBy(*keys).orderBy(s.desc() if criterion == "r2" else s.asc(), place, "model")
    return scores.where(ok).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def leaderboard(results: DataFrame, newest: str = "timestamp") -> DataFrame:
    """Nested results (model, timestamp, metrics struct) flattened, newest first."""
    return results.select("model", newest, "metrics.*").orderBy(F.col(newest).desc(), "model")


def top_importances(importances: DataFrame, n: int = 20, by: list[str] = ()) -> DataFrame:
    """The n largest (feature, importance) of each group and their share of all."""
    share = pct(F.col("importance"), F.sum("importance").over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by).orderBy(F.col("importance").desc(), "feature")
    return importances.withColumns({"share_pct": share, "rank": F.row_number().over(w)}).where(F.col("rank") <= n)
