"""Registered queries over error metrics, reports and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom import fixtures as X
from wattloom.fixtures import KEYS, with_tables
from wattloom.functions.expressions import hours_array
from wattloom.operators import cleaning as C
from wattloom.operators import metrics as M
from wattloom.operators import reports as P
from wattloom.operators.quantiles import exact_quantiles
from wattloom.plans.shape import Registry
from wattloom.schema import HOURS

R = Registry()


def _naive(spark, sf):
    return X.naive_forecast(X.demand(spark, sf))


def _errors(spark, sf):
    return M.with_errors(_naive(spark, sf), "real", "pred")


#: Metrics of (y, p) as SQL.
_METRICS = "COUNT(*) AS n, AVG(ABS(real - pred)) AS mae, SQRT(AVG((real - pred) * (real - pred))) AS rmse, 1 - SUM((real - pred) * (real - pred)) / (COUNT(*) * VAR_POP(real)) AS r2, AVG(ABS((real - pred) / real)) * 100 AS mape, COVAR_POP(real, pred) / (STDDEV_POP(real) * STDDEV_POP(pred)) AS r"


@R.add("metrics_errors", "UCP, FECHA:s, error:r, abs_error:r, error_pct:r, abs_error_pct:r", with_tables("SELECT * FROM errors", "errors"))
def metrics_errors(spark, sf):
    return _errors(spark, sf)


@R.add("metrics_all", "UCP, n:i, mae:r, rmse:r, r2:r, mape:r, r:r, rmape:r", with_tables(f"SELECT *, CASE WHEN r IS NULL THEN NULL WHEN r <= 1e-10 THEN CAST('inf' AS DOUBLE) ELSE mape / r END AS rmape FROM (SELECT UCP, {_METRICS} FROM naive GROUP BY UCP)", "naive"))
def metrics_all(spark, sf):
    return M.error_metrics(_naive(spark, sf), "real", "pred", KEYS)


@R.add("metrics_regulation", "UCP, mape:r, days:i, days_ok:i, passes:b, compliance_pct:r", with_tables("SELECT UCP, AVG(abs_error_pct) AS mape, COUNT(*) AS days, COUNT(*) FILTER (WHERE abs_error_pct < 5) AS days_ok, AVG(abs_error_pct) < 5 AS passes, COUNT(*) FILTER (WHERE abs_error_pct < 5) * 100.0 / COUNT(*) AS compliance_pct FROM errors GROUP BY UCP", "errors"))
def metrics_regulation(spark, sf):
    return M.regulation(_naive(spark, sf), "real", "pred", KEYS)


@R.add("metrics_distribution", "UCP, error_mean:r, error_median:r, error_std:r, error_max:r, error_min:r", with_tables("SELECT UCP, AVG(error) AS error_mean, QUANTILE_CONT(error, 0.5) AS error_median, STDDEV_POP(error) AS error_std, MAX(error) AS error_max, MIN(error) AS error_min FROM errors GROUP BY UCP", "errors"))
def metrics_distribution(spark, sf):
    return M.error_distribution(_naive(spark, sf), "real", "pred", KEYS)


@R.add("metrics_shares", "UCP, under_5_pct:r, under_3_pct:r, under_1_pct:r", with_tables("SELECT UCP, " + ", ".join(f"AVG(CASE WHEN abs_error_pct < {n} THEN 100.0 ELSE 0.0 END) AS under_{n}_pct" for n in (5, 3, 1)) + " FROM errors GROUP BY UCP", "errors"))
def metrics_shares(spark, sf):
    return M.error_shares(_naive(spark, sf), "real", "pred", KEYS)


@R.add("metrics_by_split", "split, n:i, mape:r, mae:r, rmse:r, bias:r, error_std:r", with_tables("SELECT CASE WHEN rn <= FLOOR(cnt * 0.6) THEN 'train' WHEN rn <= FLOOR(cnt * 0.8) THEN 'validation' ELSE 'test' END AS split, COUNT(*) AS n, AVG(abs_error_pct) AS mape, AVG(abs_error) AS mae, SQRT(AVG(error * error)) AS rmse, AVG(error) AS bias, STDDEV_POP(error) AS error_std FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY FECHA) AS rn, COUNT(*) OVER (PARTITION BY UCP) AS cnt FROM errors) GROUP BY 1", "errors"))
def metrics_by_split(spark, sf):
    from wattloom.operators.models import temporal_split

    d = temporal_split(_naive(spark, sf), KEYS, (0.6, 0.8), ("train", "validation", "test"))
    return M.split_summary(d, "real", "pred", ["split"])


@R.add("metrics_histogram", "UCP, bin:i, bin_low:r, n:i", with_tables("SELECT UCP, bin, lo + bin * (hi - lo) / 20 AS bin_low, COUNT(*) AS n FROM (SELECT UCP, lo, hi, LEAST(19, COALESCE(FLOOR((error - lo) * 20 / NULLIF(hi - lo, 0)), 0)) AS bin FROM (SELECT *, MIN(error) OVER (PARTITION BY UCP) AS lo, MAX(error) OVER (PARTITION BY UCP) AS hi FROM errors)) GROUP BY 1, 2, 3", "errors"))
def metrics_histogram(spark, sf):
    return M.histogram(_errors(spark, sf), "error", KEYS)


@R.add("metrics_describe", "UCP, n:i, mean:r, std:r, min:r, q25:r, q50:r, q75:r, max:r", with_tables("SELECT UCP, COUNT(TOTAL) AS n, AVG(TOTAL) AS mean, STDDEV_SAMP(TOTAL) AS std, MIN(TOTAL) AS min, QUANTILE_CONT(TOTAL, 0.25) AS q25, QUANTILE_CONT(TOTAL, 0.5) AS q50, QUANTILE_CONT(TOTAL, 0.75) AS q75, MAX(TOTAL) AS max FROM demand GROUP BY UCP", "demand"))
def metrics_describe(spark, sf):
    return M.describe(X.demand(spark, sf), "TOTAL", KEYS)


@R.add("metrics_worst_days", "UCP, rank:i, FECHA:s, abs_error_pct:r", with_tables("SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY abs_error_pct DESC NULLS LAST, FECHA) AS rank FROM errors) WHERE rank <= 10", "errors"))
def metrics_worst_days(spark, sf):
    return M.worst_days(_errors(spark, sf), "abs_error_pct", 10, KEYS)


@R.add("metrics_worst_overall", "UCP, FECHA:s, abs_error:r", with_tables("SELECT * FROM errors ORDER BY abs_error DESC NULLS LAST, FECHA LIMIT 10", "errors"))
def metrics_worst_overall(spark, sf):
    return M.worst_days(_errors(spark, sf), "abs_error", 10)


_REAL = "[" + ", ".join(HOURS) + "]"
_HOURLY = f"""SELECT UCP, FECHA, AVG(e) AS mae, SQRT(AVG(e * e)) AS rmse, AVG(p) AS mape, MAX(e) AS max_error, ARG_MIN(h, ROW(-e, h)) AS max_error_hour, MAX(p) AS max_error_pct, COUNT(*) FILTER (WHERE p > 5) AS hours_over FROM (SELECT UCP, FECHA, h, ABS(y * f - y) AS e, CASE WHEN y <> 0 THEN ABS((y * f - y) * 100.0 / y) END AS p FROM (SELECT UCP, FECHA, UNNEST(range(1, 25)) AS h, UNNEST({_REAL}) AS y, UNNEST([1 + ((h * 7 + day(FECHA)) % 19 - 9) / 100.0 FOR h IN range(1, 25)]) AS f FROM demand_hours)) GROUP BY 1, 2"""


def _split_errors(spark, sf):
    """Each day's hours against the same hours, each off by up to 9 percent in a fixed pattern."""
    d = X.demand_hours(spark, sf).select("UCP", "FECHA", "TOTAL", hours_array().alias("real"))
    off = lambda h: 1 + ((h * 7 + F.dayofmonth("FECHA")) % 19 - 9) / 100.0
    d = d.withColumn("pred", F.transform("real", lambda x, k: x * off(k + 1)))
    e = M.hourly_errors(d, "real", "pred")
    day = F.when(F.weekday("FECHA") >= 5, "fin_de_semana").otherwise("laboral")
    return e.withColumns({"day_type": day, "method": F.when(F.dayofmonth("FECHA") % 10 == 0, "special").otherwise("normal"), "season": F.when(F.month("FECHA").isin(4, 5, 9, 10, 11), "lluviosa").otherwise("seca")})


_SPLIT = f"SELECT *, CASE WHEN isodow(FECHA) > 5 THEN 'fin_de_semana' ELSE 'laboral' END AS day_type, CASE WHEN day(FECHA) % 10 = 0 THEN 'special' ELSE 'normal' END AS method, CASE WHEN month(FECHA) IN (4,5,9,10,11) THEN 'lluviosa' ELSE 'seca' END AS season FROM ({_HOURLY})"


@R.add("metrics_hourly", "UCP, FECHA:s, mae:r, rmse:r, mape:r, max_error:r, max_error_hour:i, max_error_pct:r, hours_over:i", with_tables(_HOURLY, "demand_hours"))
def metrics_hourly(spark, sf):
    return _split_errors(spark, sf)


@R.add("metrics_breakdown", "day_type, method, season, days:i, mae:r, rmse:r, mape:r, share_pct:r", with_tables(f"SELECT day_type, method, season, COUNT(*) AS days, AVG(mae) AS mae, AVG(rmse) AS rmse, AVG(mape) AS mape, COUNT(*) * 100.0 / MAX(COUNT(*)) OVER () AS share_pct FROM ({_SPLIT}) GROUP BY GROUPING SETS ((day_type), (method), (season), ())", "demand_hours"))
def metrics_breakdown(spark, sf):
    return M.breakdown(_split_errors(spark, sf), ["day_type", "method", "season"])


@R.add("metrics_group_summary", "day_type, mape_mean:r, mape_min:r, mape_max:r, mape_std:r, days:i", with_tables(f"SELECT day_type, ROUND(AVG(mape), 2) AS mape_mean, ROUND(MIN(mape), 2) AS mape_min, ROUND(MAX(mape), 2) AS mape_max, ROUND(STDDEV_SAMP(mape), 2) AS mape_std, COUNT(*) AS days FROM ({_SPLIT}) GROUP BY 1", "demand_hours"))
def metrics_group_summary(spark, sf):
    return M.group_summary(_split_errors(spark, sf), ["day_type"])


@R.add("metrics_hours_over", "UCP, month:s, hours_over:i, hours:i, over_pct:r, within_limit:b", with_tables(f"SELECT UCP, CAST(date_trunc('month', FECHA) AS DATE) AS month, SUM(hours_over) AS hours_over, COUNT(*) * 24 AS hours, SUM(hours_over) * 100.0 / (COUNT(*) * 24) AS over_pct, SUM(hours_over) <= 60 AS within_limit FROM ({_HOURLY}) GROUP BY 1, 2", "demand_hours"))
def metrics_hours_over(spark, sf):
    return M.hours_over_limit(_split_errors(spark, sf), KEYS)


@R.add("metrics_methods", "mape:r, mape_special:r, mape_normal:r, grade, special_worse:b", with_tables(f"SELECT *, CASE WHEN mape < 5 THEN 'excellent' WHEN mape < 10 THEN 'good' WHEN mape < 15 THEN 'acceptable' ELSE 'poor' END AS grade, COALESCE(mape_special > 1.5 * mape_normal, FALSE) AS special_worse FROM (SELECT AVG(mape) AS mape, AVG(mape) FILTER (WHERE method = 'special') AS mape_special, AVG(mape) FILTER (WHERE method = 'normal') AS mape_normal FROM ({_SPLIT}))", "demand_hours"))
def metrics_methods(spark, sf):
    return M.compare_methods(_split_errors(spark, sf))


_RUNS = "SELECT UCP, FECHA, COALESCE(bad AND LAG(bad) OVER w, FALSE) AS f, LAG(FECHA) OVER w AS before FROM (SELECT UCP, FECHA, COALESCE(abs_error_pct > 90, FALSE) AS bad FROM errors) WINDOW w AS (PARTITION BY UCP ORDER BY FECHA)"


@R.add("decision_consecutive", "UCP, consecutive:b, days", with_tables(f"SELECT UCP, BOOL_OR(f) AS consecutive, CASE WHEN BOOL_OR(f) THEN CAST(ARG_MIN(before, FECHA) FILTER (WHERE f) AS VARCHAR) || ',' ELSE '' END || COALESCE(STRING_AGG(CAST(FECHA AS VARCHAR), ',' ORDER BY FECHA) FILTER (WHERE f), '') AS days FROM ({_RUNS}) GROUP BY UCP", "errors"))
def decision_consecutive(spark, sf):
    c = M.consecutive_days(_errors(spark, sf), KEYS, limit=90.0)
    return c.withColumn("days", F.array_join(F.transform("days", lambda x: x.cast("string")), ","))


@R.add("decision_retrain", "UCP, mape:r, consecutive:b, should_retrain:b, reason", with_tables("SELECT *, mape > 5 OR consecutive AS should_retrain, CASE WHEN mape > 5 AND consecutive THEN 'ambos' WHEN consecutive THEN 'consecutivo' WHEN mape > 5 THEN 'mensual' END AS reason FROM (SELECT UCP, AVG(abs_error_pct) AS mape, BOOL_OR(f) AS consecutive FROM (SELECT *, COALESCE(abs_error_pct > 5, FALSE) AND COALESCE(LAG(abs_error_pct > 5) OVER (PARTITION BY UCP ORDER BY FECHA), FALSE) AS f FROM (SELECT * FROM errors WHERE FECHA > DATE '2001-06-01')) GROUP BY UCP)", "errors"))
def decision_retrain(spark, sf):
    """Errors of the last weeks against the regulator's limits."""
    e = _errors(spark, sf).where("FECHA > '2001-06-01'")
    m = M.error_metrics(e, "real", "pred", KEYS).select("UCP", "mape")
    return M.retrain_decision(m.join(M.consecutive_days(e, KEYS), "UCP"))


def _candidates(spark, sf):
    """Lags of 1, 7 and 14 rows as three models."""
    from pyspark.sql import Window

    w = Window.partitionBy("UCP").orderBy("FECHA")
    d = X.demand(spark, sf)
    rows = F.array(*[F.struct(F.lit(f"lag{n}").alias("model"), F.lag("TOTAL", n).over(w).alias("pred")) for n in (1, 7, 14)])
    long = d.withColumn("x", rows).select("UCP", "FECHA", F.col("TOTAL").alias("real"), F.explode("x").alias("x")).select("UCP", "FECHA", "real", "x.*").where("pred is not null")
    return M.error_metrics(long, "real", "pred", ["UCP", "model"])


_CAND = f"SELECT UCP, model, {_METRICS} FROM (SELECT UCP, FECHA, TOTAL AS real, UNNEST(['lag1', 'lag7', 'lag14']) AS model, UNNEST([LAG(TOTAL, 1) OVER w, LAG(TOTAL, 7) OVER w, LAG(TOTAL, 14) OVER w]) AS pred FROM demand WINDOW w AS (PARTITION BY UCP ORDER BY FECHA)) WHERE pred IS NOT NULL GROUP BY 1, 2"


@R.add("model_comparison", "UCP, model, n:i, mae:r, rmse:r, mape:r", with_tables(_CAND, "demand"))
def model_comparison(spark, sf):
    return _candidates(spark, sf)


@R.add("model_champion", "UCP, model, mape:r", with_tables(f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY mape, model) AS k FROM ({_CAND})) WHERE k = 1", "demand"))
def model_champion(spark, sf):
    return M.champion(_candidates(spark, sf), KEYS, "mape")


@R.add("model_leaderboard", "model, timestamp:s, mae:r, mape:r", with_tables(f"SELECT UCP || '/' || model AS model, DATE '2024-01-01' + CAST(n % 365 AS INT) AS timestamp, mae, mape FROM ({_CAND})", "demand"))
def model_leaderboard(spark, sf):
    r = _candidates(spark, sf).select(F.concat("UCP", F.lit("/"), "model").alias("model"), F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("n") % 365).cast("int")).alias("timestamp"), F.struct("mae", "mape").alias("metrics"))
    return M.leaderboard(r)


@R.add("model_top_importances", "UCP, feature, importance:r, share_pct:r, rank:i", with_tables("SELECT * FROM (SELECT UCP, feature, importance, importance * 100.0 / SUM(importance) OVER (PARTITION BY UCP) AS share_pct, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY importance DESC, feature) AS rank FROM (SELECT UCP, CAST(month(FECHA) AS VARCHAR) AS feature, SUM(TOTAL) AS importance FROM demand GROUP BY 1, 2)) WHERE rank <= 5", "demand"))
def model_top_importances(spark, sf):
    d = X.demand(spark, sf).groupBy("UCP", F.month("FECHA").cast("string").alias("feature")).agg(F.sum("TOTAL").alias("importance"))
    return M.top_importances(d, 5, KEYS)


# ---- reports

_LONG = "SELECT UCP, FECHA, UNNEST(range(1, 25)) AS periodo, UNNEST([" + ", ".join(HOURS) + "]) AS v FROM event_hours"


@R.add("report_hour_profile", "UCP, TIPO DIA, periodo:i, mean:r", with_tables("SELECT UCP, CASE WHEN isodow(FECHA) <= 5 THEN 'LABORAL' ELSE 'FESTIVO' END AS \"TIPO DIA\", periodo, AVG(v) AS mean FROM (" + _LONG.replace("event_hours", "demand_hours") + ") GROUP BY 1, 2, 3", "demand_hours"))
def report_hour_profile(spark, sf):
    return P.hour_profile(C.clean_demand(X.demand_hours(spark, sf)), ["UCP", "TIPO DIA"])


@R.add("report_weekly_means", "UCP, year:i, week:i, TIPO DIA, mean_total:r", with_tables("SELECT UCP, year(FECHA) AS year, week(FECHA) AS week, CASE WHEN isodow(FECHA) <= 5 THEN 'LABORAL' ELSE 'FESTIVO' END AS \"TIPO DIA\", AVG(TOTAL) AS mean_total FROM demand GROUP BY 1, 2, 3, 4", "demand"))
def report_weekly_means(spark, sf):
    return P.weekly_means(C.clean_demand(X.demand_hours(spark, sf)), KEYS)


@R.add("report_week_hour_matrix", "UCP, week:i, " + ", ".join(f"{h}:r" for h in range(1, 25)), with_tables("SELECT UCP, week(FECHA) AS week, " + ", ".join(f"AVG(P{h}) AS \"{h}\"" for h in range(1, 25)) + " FROM event_hours GROUP BY 1, 2", "event_hours"))
def report_week_hour_matrix(spark, sf):
    return P.week_hour_matrix(X.event_hours(spark, sf), KEYS)


@R.add("report_compare_weeks", "UCP, week:i, periodo:i, mean:r", with_tables(f"SELECT UCP, week(FECHA) AS week, periodo, AVG(v) AS mean FROM ({_LONG}) WHERE week(FECHA) IN (2, 4) GROUP BY 1, 2, 3", "event_hours"))
def report_compare_weeks(spark, sf):
    return P.compare_weeks(X.event_hours(spark, sf), [2, 4], KEYS)


@R.add("report_weekly_forecast", "UCP, week:i, mean:r, min:r, max:r, first_day:s", with_tables("SELECT UCP, week(FECHA) AS week, AVG(pred) AS mean, MIN(pred) AS min, MAX(pred) AS max, MIN(FECHA) AS first_day FROM naive GROUP BY 1, 2", "naive"))
def report_weekly_forecast(spark, sf):
    return P.weekly_forecast(_naive(spark, sf), KEYS, "pred")


@R.add("report_weekday_means", "UCP, dow:i, mean:r", with_tables("SELECT UCP, isodow(FECHA) - 1 AS dow, AVG(TOTAL) AS mean FROM demand GROUP BY 1, 2", "demand"))
def report_weekday_means(spark, sf):
    return P.weekday_means(X.demand(spark, sf), KEYS)


@R.add("report_hourly_series", "UCP, fecha_hora, periodo:i, demanda_horaria:r, tipo", with_tables(f"SELECT UCP, strftime(FECHA + INTERVAL (periodo - 1) HOUR, '%Y-%m-%d %H:%M:%S') AS fecha_hora, periodo, v AS demanda_horaria, CASE WHEN FECHA < DATE '2024-01-20' THEN 'historico' ELSE 'prediccion' END AS tipo FROM ({_LONG}) WHERE v IS NOT NULL", "event_hours"))
def report_hourly_series(spark, sf):
    d = X.event_hours(spark, sf)
    out = P.history_and_forecast(d.where("FECHA < '2024-01-20'"), d.where("FECHA >= '2024-01-20'"), KEYS)
    return out.withColumn("fecha_hora", F.date_format("fecha_hora", "yyyy-MM-dd HH:mm:ss"))


@R.add("report_error_matrix", "UCP, FECHA:s, periodo:i, error:r, error_pct:r", with_tables(f"SELECT a.UCP, a.FECHA, a.periodo, b.v - a.v AS error, CASE WHEN a.v <> 0 THEN (b.v - a.v) * 100.0 / a.v END AS error_pct FROM ({_LONG}) a JOIN ({_LONG}) b ON a.UCP = b.UCP AND a.periodo = b.periodo AND a.FECHA = b.FECHA + 7", "event_hours"))
def report_error_matrix(spark, sf):
    d = X.event_hours(spark, sf)
    return P.error_matrix(d.withColumn("FECHA", F.date_add("FECHA", 7)), d, KEYS)


@R.add("report_daily_history", "UCP, FECHA:s, TOTAL:r", with_tables("SELECT UCP, FECHA, " + " + ".join(f"COALESCE({h}, 0)" for h in HOURS) + " AS TOTAL FROM event_hours WHERE FECHA BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'", "event_hours"))
def report_daily_history(spark, sf):
    return P.daily_history(X.event_hours(spark, sf).drop("TOTAL"), KEYS, "2024-01-05", "2024-01-25")


@R.add("report_last_rows", "UCP, FECHA:s, TOTAL:r, kind", with_tables("SELECT UCP, FECHA, TOTAL, 'rows' AS kind FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY FECHA DESC) AS n FROM demand) WHERE n <= 20 UNION ALL SELECT UCP, FECHA, TOTAL, 'days' FROM (SELECT *, MAX(FECHA) OVER (PARTITION BY UCP) AS e FROM demand) WHERE FECHA > e - 20", "demand"))
def report_last_rows(spark, sf):
    d = X.demand(spark, sf)
    return P.last_rows(d, 20, KEYS).withColumn("kind", F.lit("rows")).unionByName(P.last_days(d, 20, KEYS).withColumn("kind", F.lit("days")))


@R.add("report_side_by_side", "UCP, FECHA:s, pred:r, TOTAL_historico:r", with_tables("SELECT n.UCP, n.FECHA, n.pred, d.TOTAL AS TOTAL_historico FROM naive n LEFT JOIN demand d ON d.UCP = n.UCP AND d.FECHA = n.FECHA AND d.FECHA < DATE '2000-01-01'", "naive", "demand"))
def report_side_by_side(spark, sf):
    d = X.demand(spark, sf)
    return P.side_by_side(X.naive_forecast(d).select("UCP", "FECHA", "pred"), d.where("FECHA < '2000-01-01'"), KEYS, "FECHA", "TOTAL")


@R.add("report_categories", "UCP, days:i", with_tables("SELECT UCP, COUNT(*) AS days FROM demand WHERE UCP IN ('ASIA', 'EUROPE') GROUP BY 1", "demand"))
def report_categories(spark, sf):
    return P.of_categories(X.demand(spark, sf), "UCP", ["ASIA", "EUROPE"]).groupBy("UCP").agg(F.count(F.lit(1)).alias("days"))


_PROBS = {"p05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "p95": 0.95}
_QUANTILES = ", ".join(f"quantile_cont(l_extendedprice, {p}) AS {n}" for n, p in _PROBS.items())


@R.add("quantiles_spread", "l_returnflag, n:i, " + ", ".join(f"{n}:r" for n in _PROBS), f"SELECT l_returnflag, COUNT(*) AS n, {_QUANTILES} FROM lineitem GROUP BY 1")
def quantiles_spread(spark, sf):
    """Exact quantiles of three groups that hold all line items, of which no task holds one whole."""
    return exact_quantiles(X.read(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], _PROBS)


@R.add("quality_iqr_spread", "l_returnflag, q1:r, q3:r, n:i, outliers:i", "SELECT l_returnflag, q1, q3, COUNT(*) AS n, COUNT(*) FILTER (WHERE v < q1 - 0.5 * (q3 - q1) OR v > q3 + 0.5 * (q3 - q1)) AS outliers FROM (SELECT l_returnflag, l_extendedprice AS v, quantile_cont(l_extendedprice, 0.25) OVER (PARTITION BY l_returnflag) AS q1, quantile_cont(l_extendedprice, 0.75) OVER (PARTITION BY l_returnflag) AS q3 FROM lineitem) GROUP BY 1, 2, 3")
def quality_iqr_spread(spark, sf):
    """Fences of half the quartiles' distance by exact quartiles of huge groups."""
    return C.iqr_outliers(X.read(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], factor=0.5, spread=True)
