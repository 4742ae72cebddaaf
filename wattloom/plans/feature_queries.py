"""Registered queries over sources, cleaning and training features."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from wattloom import fixtures as X
from wattloom.fixtures import KEYS, with_tables
from wattloom.functions.calendar import calendar_features, classify_days, cyclic_features, season_features
from wattloom.operators import blocked as BL
from wattloom.operators import cleaning as C
from wattloom.operators import features as E
from wattloom.plans.shape import Registry
from wattloom.schema import DEMAND_FEED, HOLIDAY_FILE, HOURS, WEATHER_DAILY, WEATHER_FEED
from wattloom.session import scratch, stored
from wattloom.sources import files as S

R = Registry()
_CHRISTMAS = "((month(FECHA) = 12 AND day(FECHA) >= 23) OR (month(FECHA) = 1 AND day(FECHA) <= 6))"
_LABORAL = "CASE WHEN isodow(FECHA) <= 5 THEN 'LABORAL' ELSE 'FESTIVO' END"
_FEST = "(isodow(FECHA) > 5)"  # TIPO DIA is a weekday name here


def _daily(spark, sf):
    return C.clean_demand(X.demand_hours(spark, sf))


def _weather(spark, sf):
    return C.weather_daily(X.weather_hours(spark, sf), KEYS)


# ---- sources


_HOUR_SUM = " + ".join(f"COALESCE({h}, 0)" for h in HOURS)


@R.add("source_demand_feed", "UCP, VARIABLE, FECHA:s, TIPO DIA, P1:r, P12:r, P24:r, TOTAL:r", with_tables(f"""SELECT UCP, VARIABLE, FECHA, "TIPO DIA", P1, P12, P24, {_HOUR_SUM} AS TOTAL FROM event_hours""", "event_hours"))
def source_demand_feed(spark, sf):
    """The demand feed of every unit, written as JSON text from the hourly table and parsed back."""
    row = F.struct(F.col("FECHA").cast("string").alias("fecha"), *[F.col(f"P{h}").alias(f"p{h}") for h in range(1, 25)])
    text = X.event_hours(spark, sf).select("UCP", F.to_json(F.struct(F.array(row).alias("data"))).alias("j"))
    return S.demand_from_feed(text.select("UCP", F.from_json("j", DEMAND_FEED).alias("f")).select("UCP", "f.data"), F.col("UCP"))


@R.add("source_weather_feed", "UCP, fecha:s, periodo:i, p_t:r, p_h:r, p_v:r, p_i:r", with_tables("SELECT UCP, FECHA AS fecha, UNNEST(range(1, 25)) AS periodo, UNNEST([" + ", ".join(HOURS) + "]) AS p_t, UNNEST([" + ", ".join(f"{h} * 2" for h in HOURS) + "]) AS p_h, CAST(NULL AS DOUBLE) AS p_v, 0.5 AS p_i FROM event_hours", "event_hours"))
def source_weather_feed(spark, sf):
    cols = [x for h in range(1, 25) for x in (F.col(f"P{h}").alias(f"p{h}_t"), (F.col(f"P{h}") * 2).alias(f"p{h}_h"), F.lit(0.5).alias(f"p{h}_i"))]
    text = X.event_hours(spark, sf).select("UCP", F.to_json(F.struct(F.array(F.struct(F.col("FECHA").cast("string").alias("fecha"), *cols)).alias("data"))).alias("j"))
    return S.weather_from_feed(text.select("UCP", F.from_json("j", WEATHER_FEED).alias("f")).select("UCP", "f.data"), F.col("UCP"))


@R.add("source_holidays", "UCP, FECHA:s, nombre", "SELECT DISTINCT 'unit' AS UCP, CAST(o_orderdate AS DATE) AS FECHA, CASE WHEN o_orderstatus = 'F' THEN 'closed' END AS nombre FROM orders")
def source_holidays(spark, sf):
    """A holiday file for every order."""
    o = X.read(spark, sf, "orders").select(F.to_date("o_orderdate").cast("string").alias("d"), "o_orderstatus")
    doc = F.struct(F.array("d").alias("festivos"), F.when(F.col("o_orderstatus") == "F", F.create_map("d", F.lit("closed"))).alias("descripcion_festivos"))
    return S.holidays_from_file(o.select(F.from_json(F.to_json(doc), HOLIDAY_FILE).alias("f")).select("f.*"), "unit").distinct()


for _n in ("source_demand_feed", "source_weather_feed", "source_holidays"):  # two names for each
    R.queries[f"{_n}_all"], R.sql[f"{_n}_all"] = R.queries[_n], R.sql[_n]


@R.add("source_latest_days", "UCP, FECHA:s, TOTAL:r", with_tables("SELECT * FROM demand WHERE FECHA BETWEEN DATE '2000-01-31' - 30 AND DATE '2000-01-31'", "demand"))
def source_latest_days(spark, sf):
    return S.latest(X.demand(spark, sf), 30, F.to_date(F.lit("2000-01-31")))


@R.add("weather_daily", "UCP, " + ", ".join("FECHA:s" if c == "FECHA" else f"{c}:r" for c in WEATHER_DAILY), with_tables("SELECT * FROM weather WHERE FECHA BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", "weather"))
def weather_daily(spark, sf):
    """Range filter first, then hours to days."""
    return C.weather_daily(S.check_weather(X.weather_hours(spark, sf), "1996-01-01", "1998-12-31"), KEYS)


# ---- cleaning


@R.add("clean_demand", "UCP, FECHA:s, TIPO DIA, EVENTO, P1:r, P24:r, TOTAL:r", with_tables(f"""SELECT UCP, FECHA, {_LABORAL} AS "TIPO DIA", '0' AS EVENTO, P1, P24, TOTAL FROM event_hours WHERE {' AND '.join(f'P{h} IS NOT NULL' for h in range(1, 25))}""", "event_hours"))
def clean_demand(spark, sf):
    dirty = X.event_hours(spark, sf).withColumns({"Unnamed: 0": F.lit(1), "extra": F.lit("x"), **{h: F.col(h).cast("string") for h in HOURS}})
    return C.clean_demand(dirty)


@R.add("quality_missing", "column, null_pct:r, status", with_tables("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS null_pct, CASE WHEN AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 > 5 THEN 'ALERT' ELSE 'OK' END AS status FROM event_hours" for c in HOURS) + ")", "event_hours"))
def quality_missing(spark, sf):
    return C.null_percentages(X.event_hours(spark, sf), HOURS)


@R.add("quality_removed", "UCP, rows_before:i, removed:i, removed_pct:r, alert:b", with_tables("SELECT UCP, COUNT(*) AS rows_before, SUM(bad) AS removed, SUM(bad) * 100.0 / COUNT(*) AS removed_pct, SUM(bad) * 100.0 / COUNT(*) > 5 AS alert FROM (SELECT UCP, CASE WHEN " + " OR ".join(f"{h} IS NULL" for h in HOURS) + " THEN 1 ELSE 0 END AS bad FROM event_hours) GROUP BY UCP", "event_hours"))
def quality_removed(spark, sf):
    d = X.event_hours(spark, sf)
    return C.removed_rows(d, C.drop_incomplete(d, C.CRITICAL_DEMAND), KEYS)


@R.add("quality_sigma_outliers", "UCP, column, outliers:i", with_tables("SELECT UCP, \"column\", COUNT(*) FILTER (WHERE ABS(v - m) > 2 * s) AS outliers FROM (SELECT *, AVG(v) OVER w AS m, STDDEV_SAMP(v) OVER w AS s FROM (SELECT UCP, UNNEST([" + ", ".join(f"'{h}'" for h in HOURS) + "]) AS \"column\", UNNEST([" + ", ".join(HOURS) + "]) AS v FROM demand_hours) WINDOW w AS (PARTITION BY UCP, \"column\")) GROUP BY 1, 2", "demand_hours"))
def quality_sigma_outliers(spark, sf):
    return C.sigma_outliers(X.demand_hours(spark, sf), HOURS, KEYS, sigma=2.0)


_RANGES = {"temp_mean": (5, 40), "humidity_mean": (0, 100), "wind_speed_mean": (0, 50), "rain_sum": (0, 300)}


@R.add("quality_range_outliers", "UCP, column, outliers:i", with_tables(" UNION ALL ".join(f"SELECT UCP, '{c}' AS \"column\", SUM(CASE WHEN {c} < {a} OR {c} > {b} THEN 1 ELSE 0 END) AS outliers FROM weather GROUP BY UCP" for c, (a, b) in _RANGES.items()), "weather"))
def quality_range_outliers(spark, sf):
    return C.range_outliers(_weather(spark, sf), KEYS)


@R.add("quality_iqr_outliers", "UCP, q1:r, q3:r, n:i, outliers:i, outlier_pct:r, alert:b", with_tables("SELECT UCP, q1, q3, COUNT(TOTAL) AS n, COUNT(*) FILTER (WHERE TOTAL < q1 - 1.5 * (q3 - q1) OR TOTAL > q3 + 1.5 * (q3 - q1)) AS outliers, COUNT(*) FILTER (WHERE TOTAL < q1 - 1.5 * (q3 - q1) OR TOTAL > q3 + 1.5 * (q3 - q1)) * 100.0 / COUNT(TOTAL) AS outlier_pct, COUNT(*) FILTER (WHERE TOTAL < q1 - 1.5 * (q3 - q1) OR TOTAL > q3 + 1.5 * (q3 - q1)) * 100.0 / COUNT(TOTAL) > 1 AS alert FROM demand JOIN (SELECT UCP AS u, QUANTILE_CONT(TOTAL, 0.25) AS q1, QUANTILE_CONT(TOTAL, 0.75) AS q3 FROM demand GROUP BY 1) ON UCP = u GROUP BY 1, 2, 3", "demand"))
def quality_iqr_outliers(spark, sf):
    return C.iqr_outliers(X.demand(spark, sf), "TOTAL", KEYS)


@R.add("quality_inconsistent_totals", "UCP, rows:i, inconsistent:i", with_tables("SELECT UCP, COUNT(*) AS rows, SUM(CASE WHEN ABS((t - s) * 100.0 / t) > 1 THEN 1 ELSE 0 END) AS inconsistent FROM (SELECT UCP, CASE WHEN day(FECHA) % 7 = 0 THEN TOTAL * 1.02 ELSE TOTAL END AS t, " + " + ".join(HOURS) + " AS s FROM demand_hours) GROUP BY UCP", "demand_hours"))
def quality_inconsistent_totals(spark, sf):
    d = X.demand_hours(spark, sf).withColumn("TOTAL", F.when(F.dayofmonth("FECHA") % 7 == 0, F.col("TOTAL") * 1.02).otherwise(F.col("TOTAL")))
    return C.inconsistent_totals(d, KEYS)


@R.add("quality_final_stats", "rows:i, first_day:s, last_day:s, units:i, variables:i", with_tables("SELECT COUNT(*) AS rows, MIN(FECHA) AS first_day, MAX(FECHA) AS last_day, COUNT(DISTINCT UCP) AS units, COUNT(DISTINCT VARIABLE) AS variables FROM demand_hours", "demand_hours"))
def quality_final_stats(spark, sf):
    return C.final_stats(X.demand_hours(spark, sf))


@R.add("quality_day_types", "UCP, TIPO DIA, days:i", with_tables(f"""SELECT UCP, {_LABORAL} AS "TIPO DIA", COUNT(*) AS days FROM demand_hours GROUP BY 1, 2""", "demand_hours"))
def quality_day_types(spark, sf):
    return C.day_type_counts(_daily(spark, sf), KEYS)


@R.add("quality_alert_rollup", "level, check, alerts:i, grouping:i", with_tables("""SELECT level, "check", COUNT(*) AS alerts, GROUPING(level, "check") AS grouping FROM (SELECT CASE WHEN n > 5 THEN 'ALERT' ELSE 'OK' END AS level, CASE WHEN h <= 12 THEN 'morning' ELSE 'evening' END AS "check" FROM (SELECT h, AVG(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS n FROM (SELECT UCP, UNNEST(range(1, 25)) AS h, UNNEST([""" + ", ".join(HOURS) + """]) AS v FROM event_hours) GROUP BY UCP, h)) GROUP BY GROUPING SETS ((level), ("check"), (level, "check"), ())""", "event_hours"))
def quality_alert_rollup(spark, sf):
    q = C.null_percentages(X.event_hours(spark, sf), HOURS, KEYS)
    part = F.when(F.expr("cast(substring(column, 2) as int)") <= 12, "morning").otherwise("evening")
    return C.alert_rollup(q.select(F.col("status").alias("level"), part.alias("check")))


@R.add("append_demand", "UCP, FECHA:s, TOTAL:r", with_tables("SELECT UCP, FECHA, TOTAL FROM demand WHERE FECHA < DATE '2000-01-01' UNION ALL SELECT UCP, FECHA, TOTAL * 2 FROM demand WHERE FECHA >= DATE '2000-01-01'", "demand"))
def append_demand(spark, sf):
    d = X.demand(spark, sf)
    new = d.where("FECHA >= '1999-06-01'").withColumn("TOTAL", F.col("TOTAL") * 2)
    return C.append_demand(d.where("FECHA < '2000-01-01'"), new, KEYS)


def _csv(spark, sf):
    """Demand as CSV, a file for each unit: two have their columns in another order and one more; lines of the 13th lack
    their last field, those of the 14th have one too many."""
    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}"
    d = X.demand(spark, sf).withColumn("swap", F.col("UCP").isin("ASIA", "EUROPE"))
    line = F.when(F.col("swap"), F.concat_ws(",", "FECHA", "UCP", "TOTAL", F.lit("note"))).otherwise(F.concat_ws(",", "UCP", "FECHA", "TOTAL"))
    line = F.when(F.dayofmonth("FECHA") == 13, F.regexp_replace(line, ",[^,]*$", "")).when(F.dayofmonth("FECHA") == 14, F.concat(line, F.lit(",x"))).otherwise(line)
    head = d.select("UCP", "swap").distinct().select("UCP", F.lit(0).alias("k"), F.when(F.col("swap"), "FECHA,UCP,TOTAL,remark").otherwise("UCP,FECHA,TOTAL").alias("value"))
    both = head.unionByName(d.select("UCP", F.lit(1).alias("k"), line.alias("value")))
    both.repartition("UCP").sortWithinPartitions("UCP", "k").select(F.col("UCP").alias("unit"), "value").write.partitionBy("unit").text(path)
    return S.read_by_header(spark, path, ["UCP", "FECHA", "TOTAL"])


@R.add("source_csv_rows", "UCP, FECHA:s, TOTAL:r, remark", with_tables("SELECT UCP, FECHA, TOTAL, CASE WHEN UCP IN ('ASIA', 'EUROPE') THEN 'note' END AS remark FROM demand WHERE day(FECHA) NOT IN (13, 14)", "demand"))
def source_csv_rows(spark, sf):
    """CSV files of two layouts with broken lines, read by their headers."""
    return _csv(spark, sf)[0].withColumns({"FECHA": F.to_date("FECHA"), "TOTAL": F.col("TOTAL").try_cast("double")})


@R.add("source_csv_alerts", "unit, check, level, n:i", with_tables("""SELECT UCP AS unit, 'broken_fields' AS "check", 'ALERT' AS level, COUNT(*) AS n FROM demand WHERE day(FECHA) IN (13, 14) GROUP BY 1 UNION ALL SELECT UCP, 'column_remark', 'WARNING', COUNT(*) FROM demand WHERE day(FECHA) NOT IN (13, 14) AND UCP NOT IN ('ASIA', 'EUROPE') GROUP BY 1""", "demand"))
def source_csv_alerts(spark, sf):
    """Broken lines and columns that lack, by file."""
    a = S.file_alerts(*_csv(spark, sf), ["UCP", "FECHA", "TOTAL", "remark"])
    return a.withColumn("unit", F.regexp_replace(F.regexp_extract("source_file", "unit=([^/]+)", 1), "%20", " "))


_LANDED = "SELECT UCP, FECHA, TOTAL, strftime(FECHA, '%Y-%m') AS month FROM (SELECT UCP, FECHA, CASE WHEN FECHA < DATE '1996-01-01' THEN TOTAL WHEN FECHA < DATE '1997-01-01' THEN TOTAL * 2 ELSE TOTAL * 3 END AS TOTAL FROM demand)"


def _land(spark, sf):
    """The table after four increments, the second of them twice, and what each wrote."""
    path, d = f"{scratch(spark)}/landed-{uuid.uuid4().hex}", stored(X.demand(spark, sf), "demand")
    parts = [d.where("FECHA < '1996-01-01'")] + 2 * [d.where("FECHA BETWEEN '1995-11-15' AND '1996-12-31'").withColumn("TOTAL", F.col("TOTAL") * 2)] + [d.where("FECHA >= '1996-12-30'").withColumn("TOTAL", F.col("TOTAL") * 3)]
    logs = [S.land_increment(p, path, KEYS).withColumn("step", F.lit(k + 1)) for k, p in enumerate(parts)]
    return S.table_by_month(spark, path), reduce(lambda a, b: a.unionByName(b), logs)


@R.add("append_increments", "UCP, FECHA:s, TOTAL:r, landed_month", with_tables(f"SELECT UCP, FECHA, TOTAL, month AS landed_month FROM ({_LANDED})", "demand"))
def append_increments(spark, sf):
    """Increments that overlap, one of them repeated, land by month: the first value of a day stays."""
    return _land(spark, sf)[0]


@R.add("append_increments_log", "step:i, landed_month, added:i, changed:i", with_tables(f"SELECT CASE WHEN FECHA < DATE '1996-01-01' THEN 1 WHEN FECHA < DATE '1997-01-01' THEN 2 ELSE 4 END AS step, month AS landed_month, COUNT(*) AS added, 0 AS changed FROM ({_LANDED}) GROUP BY 1, 2", "demand"))
def append_increments_log(spark, sf):
    """The months that each increment wrote; the repeated one (step 3) none."""
    return _land(spark, sf)[1]


@R.add("append_weather", "UCP, fecha:s, readings:i, rain:r", with_tables("SELECT UCP, fecha, COUNT(*) AS readings, SUM(p_i) AS rain FROM (SELECT DISTINCT * FROM weather_hours) GROUP BY 1, 2", "weather_hours"))
def append_weather(spark, sf):
    w = X.weather_hours(spark, sf)
    both = C.append_weather(w.where("fecha < '1999-01-01'"), w.where("fecha >= '1998-01-01'"))
    return both.groupBy("UCP", "fecha").agg(F.count(F.lit(1)).alias("readings"), F.sum("p_i").alias("rain"))


@R.add("next_start", "UCP, start:s", with_tables("SELECT r_name AS UCP, COALESCE(m, DATE '2005-11-06') AS start FROM region LEFT JOIN (SELECT UCP, MAX(FECHA) AS m FROM demand WHERE UCP <> 'ASIA' GROUP BY 1) ON UCP = r_name", "demand"))
def next_start(spark, sf):
    keys = X.read(spark, sf, "region").select(F.col("r_name").alias("UCP"))
    return C.next_start(X.demand(spark, sf).where("UCP <> 'ASIA'"), KEYS, keys)


# ---- features

_CAL = "year:i, month:i, day:i, dayofweek:i, dayofyear:i, week:i, quarter:i, is_weekend:i, is_saturday:i, is_sunday:i, is_month_start:i, is_month_end:i, is_quarter_start:i, is_quarter_end:i, is_festivo:i"


_CAL_SQL = with_tables(f"""SELECT UCP, FECHA, year(FECHA) AS year, month(FECHA) AS month, day(FECHA) AS day, isodow(FECHA) - 1 AS dayofweek, dayofyear(FECHA) AS dayofyear, week(FECHA) AS week, quarter(FECHA) AS quarter, isodow(FECHA) > 5 AS is_weekend, isodow(FECHA) = 6 AS is_saturday, isodow(FECHA) = 7 AS is_sunday, day(FECHA) = 1 AS is_month_start, FECHA = last_day(FECHA) AS is_month_end, FECHA = date_trunc('quarter', FECHA) AS is_quarter_start, FECHA + 1 = date_trunc('quarter', FECHA + 1) AS is_quarter_end, {_FEST} AS is_festivo, sin(2 * pi() * (isodow(FECHA) - 1) / 7) AS dayofweek_sin, cos(2 * pi() * (isodow(FECHA) - 1) / 7) AS dayofweek_cos, sin(2 * pi() * month(FECHA) / 12) AS month_sin, cos(2 * pi() * month(FECHA) / 12) AS month_cos, sin(2 * pi() * dayofyear(FECHA) / 365) AS dayofyear_sin, cos(2 * pi() * dayofyear(FECHA) / 365) AS dayofyear_cos FROM demand""", "demand")


@R.add("features_calendar", f"UCP, FECHA:s, {_CAL}, dayofweek_sin:r, dayofweek_cos:r, month_sin:r, month_cos:r, dayofyear_sin:r, dayofyear_cos:r", _CAL_SQL)
def features_calendar(spark, sf):
    return cyclic_features(calendar_features(_daily(spark, sf)))


@R.add("features_calendar_serving", "UCP, FECHA:s, month_sin:r, month_cos:r", with_tables("SELECT UCP, FECHA, sin(2 * pi() * (month(FECHA) - 1) / 12) AS month_sin, cos(2 * pi() * (month(FECHA) - 1) / 12) AS month_cos FROM demand", "demand"))
def features_calendar_serving(spark, sf):
    return cyclic_features(calendar_features(X.demand(spark, sf), festivo=F.lit(False)), mode="serve")


_SEASON_SQL = with_tables(f"""SELECT UCP, FECHA, CASE WHEN month(FECHA) IN (4,5,10,11) THEN 'rainy' ELSE 'dry' END AS season, month(FECHA) IN (4,5,10,11) AS is_rainy_season, month(FECHA) = 1 AS is_january, month(FECHA) = 12 AS is_december, (day(FECHA) - 1) // 7 + 1 AS week_of_month, {_CHRISTMAS} AS is_christmas_season, month(FECHA) = 1 AND day(FECHA) BETWEEN 7 AND 15 AS is_post_season, NOT {_CHRISTMAS} AS is_high_season, LEAST(30, COALESCE(rn - MAX(CASE WHEN {_FEST} THEN rn END) OVER (PARTITION BY UCP ORDER BY FECHA), 30)) AS days_since_holiday FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY FECHA) AS rn FROM demand)""", "demand")


@R.add("features_season", "UCP, FECHA:s, season, is_rainy_season:i, is_january:i, is_december:i, week_of_month:i, is_christmas_season:i, is_post_season:i, is_high_season:i, days_since_holiday:i", _SEASON_SQL)
def features_season(spark, sf):
    return E.days_since_holiday(season_features(calendar_features(_daily(spark, sf))), KEYS)


@R.add("features_lags", "UCP, FECHA:s, total_lag_1d:r, total_lag_7d:r, total_lag_14d:r, p8_lag_1d:r, p20_lag_7d:r, total_day_change:r, total_day_change_pct:r", with_tables("SELECT UCP, FECHA, LAG(TOTAL, 1) OVER w AS total_lag_1d, LAG(TOTAL, 7) OVER w AS total_lag_7d, LAG(TOTAL, 14) OVER w AS total_lag_14d, LAG(P8, 1) OVER w AS p8_lag_1d, LAG(P20, 7) OVER w AS p20_lag_7d, TOTAL - LAG(TOTAL, 1) OVER w AS total_day_change, (TOTAL - LAG(TOTAL, 1) OVER w) * 100.0 / LAG(TOTAL, 1) OVER w AS total_day_change_pct FROM demand_hours WINDOW w AS (PARTITION BY UCP ORDER BY FECHA)", "demand_hours"))
def features_lags(spark, sf):
    d = E.day_change(E.row_lags(_daily(spark, sf), KEYS), KEYS)
    for p in E.PEAK_HOURS:
        d = E.row_lags(d, KEYS, p, E.PEAK_LAGS)
    return d


_ANNUAL_SQL = with_tables("WITH y AS (SELECT d.UCP, d.FECHA, strftime(d.FECHA, '%m-%d') AS md, a.TOTAL AS y1, b.TOTAL AS y2, c.TOTAL AS y3, d.TOTAL AS t FROM demand d LEFT JOIN demand a ON a.UCP = d.UCP AND a.FECHA = d.FECHA - INTERVAL 1 YEAR LEFT JOIN demand b ON b.UCP = d.UCP AND b.FECHA = d.FECHA - INTERVAL 2 YEAR LEFT JOIN demand c ON c.UCP = d.UCP AND c.FECHA = d.FECHA - INTERVAL 3 YEAR) SELECT UCP, FECHA, " + ", ".join(f"COALESCE(y{n}, AVG(y{n}) OVER (PARTITION BY UCP, md), AVG(t) OVER (PARTITION BY UCP)) AS total_lag_{n}y" for n in (1, 2, 3)) + " FROM y", "demand")


@R.add("features_annual_lags", "UCP, FECHA:s, total_lag_1y:r, total_lag_2y:r, total_lag_3y:r", _ANNUAL_SQL)
def features_annual_lags(spark, sf):
    return E.annual_lags(X.demand(spark, sf), KEYS)


_ROLL = [(w, n, f) for w in (7, 14, 28) for n, f in (("mean", "AVG"), ("std", "STDDEV_SAMP"), ("min", "MIN"), ("max", "MAX"))]


_ROLL_SQL = with_tables(f"WITH c AS (SELECT *, CASE WHEN NOT {_CHRISTMAS} THEN TOTAL END AS x FROM demand) SELECT UCP, FECHA, " + ", ".join(f"COALESCE(CASE WHEN COUNT(x) OVER w{w} >= {max(1, w // 2)} THEN {f}(x) OVER w{w} END, {f}(TOTAL) OVER w{w}) AS total_rolling_{n}_{w}d" for w, n, f in _ROLL) + " FROM c WINDOW " + ", ".join(f"w{w} AS (PARTITION BY UCP ORDER BY FECHA ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in (7, 14, 28)), "demand")


@R.add("features_rolling", "UCP, FECHA:s, " + ", ".join(f"total_rolling_{n}_{w}d:r" for w, n, _ in _ROLL), _ROLL_SQL)
def features_rolling(spark, sf):
    return E.rolling_stats(X.demand(spark, sf), KEYS)


_GAPS = "SELECT d.UCP, d.FECHA, w.temp_mean, w.rain_sum FROM demand d LEFT JOIN weather w ON w.UCP = d.UCP AND w.FECHA = d.FECHA"


def _weather_gaps(spark, sf):
    """Weather by demand day, null on days without a reading."""
    return X.demand(spark, sf).select("UCP", "FECHA").join(_weather(spark, sf).select("UCP", "FECHA", "temp_mean", "rain_sum"), [*KEYS, "FECHA"], "left")


@R.add("features_fill_forward_blocks", "UCP, FECHA:s, temp_mean:r, rain_sum:r", with_tables("SELECT UCP, FECHA, " + ", ".join(f"COALESCE(LAST_VALUE({c} IGNORE NULLS) OVER (PARTITION BY UCP ORDER BY FECHA ROWS UNBOUNDED PRECEDING), 0) AS {c}" for c in ("temp_mean", "rain_sum")) + f" FROM ({_GAPS})", "demand", "weather"))
def features_fill_forward_blocks(spark, sf):
    """The last known value by key and month, so that a key isn't one task."""
    return BL.fill_forward(_weather_gaps(spark, sf), KEYS, ["temp_mean", "rain_sum"])


@R.add("features_day_change_blocks", "UCP, FECHA:s, temp_mean_day_change:r, temp_mean_day_change_pct:r", with_tables(f"SELECT UCP, FECHA, temp_mean - LAG(temp_mean) OVER w AS temp_mean_day_change, CASE WHEN before <> 0 THEN (COALESCE(temp_mean, before) - before) * 100.0 / before END AS temp_mean_day_change_pct FROM (SELECT *, LAST_VALUE(temp_mean IGNORE NULLS) OVER (PARTITION BY UCP ORDER BY FECHA ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_GAPS})) WINDOW w AS (PARTITION BY UCP ORDER BY FECHA)", "demand", "weather"))
def features_day_change_blocks(spark, sf):
    return BL.day_change(_weather_gaps(spark, sf), KEYS, "temp_mean")


_WEATHER_SQL = with_tables(f"""SELECT d.UCP, d.FECHA, LAG(temp_mean) OVER w AS temp_lag1d, LAG(humidity_mean) OVER w AS humidity_lag1d, LAG(wind_speed_mean) OVER w AS wind_speed_lag1d, LAG(rain_mean) OVER w AS rain_lag1d, temp_mean * CAST(isodow(d.FECHA) > 5 AS INT) AS temp_x_is_weekend, temp_mean * CAST(isodow(d.FECHA) > 5 AS INT) AS temp_x_is_festivo, humidity_mean * CAST(isodow(d.FECHA) > 5 AS INT) AS humidity_x_is_weekend, COALESCE(rain_sum > 1, FALSE) AS is_rainy_day, (isodow(d.FECHA) - 1) * CAST(isodow(d.FECHA) > 5 AS INT) AS dayofweek_x_festivo, month(d.FECHA) * CAST(isodow(d.FECHA) > 5 AS INT) AS month_x_festivo, month(d.FECHA) * CAST(isodow(d.FECHA) > 5 AS INT) AS weekend_x_month FROM demand d LEFT JOIN weather t ON t.UCP = d.UCP AND t.FECHA = d.FECHA WINDOW w AS (PARTITION BY d.UCP ORDER BY d.FECHA)""", "demand", "weather")


@R.add("features_weather", "UCP, FECHA:s, temp_lag1d:r, humidity_lag1d:r, wind_speed_lag1d:r, rain_lag1d:r, temp_x_is_weekend:r, temp_x_is_festivo:r, humidity_x_is_weekend:r, is_rainy_day:i, dayofweek_x_festivo:i, month_x_festivo:i, weekend_x_month:i", _WEATHER_SQL)
def features_weather(spark, sf):
    return E.interaction_features(E.weather_features(calendar_features(_daily(spark, sf)), _weather(spark, sf), KEYS))


@R.add("features_train", "UCP, year:i, month:i, days:i, lag_7:r, rolling_7:r, rolling_std_28:r, festivos:i, temp_lag:r", with_tables(f"WITH c AS (SELECT d.UCP, d.FECHA, TOTAL, CASE WHEN NOT ({_CHRISTMAS.replace('FECHA', 'd.FECHA')}) THEN TOTAL END AS x, temp_mean FROM demand d LEFT JOIN weather t ON t.UCP = d.UCP AND t.FECHA = d.FECHA), f AS (SELECT UCP, FECHA, LAG(TOTAL, 7) OVER w AS lag_7, COALESCE(CASE WHEN COUNT(x) OVER w7 >= 3 THEN AVG(x) OVER w7 END, AVG(TOTAL) OVER w7) AS r7, COALESCE(CASE WHEN COUNT(x) OVER w28 >= 14 THEN STDDEV_SAMP(x) OVER w28 END, STDDEV_SAMP(TOTAL) OVER w28) AS s28, isodow(FECHA) > 5 AS fest, LAG(temp_mean) OVER w AS tl FROM c WINDOW w AS (PARTITION BY UCP ORDER BY FECHA), w7 AS (PARTITION BY UCP ORDER BY FECHA ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w28 AS (PARTITION BY UCP ORDER BY FECHA ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)), g AS (SELECT UCP, FECHA, fest, COALESCE(lag_7, 0) AS lag_7, COALESCE(r7, 0) AS r7, COALESCE(s28, 0) AS s28, COALESCE(LAST_VALUE(tl IGNORE NULLS) OVER (PARTITION BY UCP ORDER BY FECHA ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS tl FROM f) SELECT UCP, year(FECHA) AS year, month(FECHA) AS month, COUNT(*) AS days, AVG(lag_7) AS lag_7, AVG(r7) AS rolling_7, AVG(s28) AS rolling_std_28, SUM(CAST(fest AS INT)) AS festivos, AVG(tl) AS temp_lag FROM g GROUP BY 1, 2, 3", "demand", "weather"))
def features_train(spark, sf):
    """Ingest, clean, build all training features, and their monthly means."""
    f = E.build_features(_daily(spark, sf), _weather(spark, sf), KEYS)
    return f.groupBy("UCP", "year", "month").agg(F.count(F.lit(1)).alias("days"), F.avg("total_lag_7d").alias("lag_7"), F.avg("total_rolling_mean_7d").alias("rolling_7"), F.avg("total_rolling_std_28d").alias("rolling_std_28"), F.sum("is_festivo").alias("festivos"), F.avg("temp_lag1d").alias("temp_lag"))


#: All 68 training features: the five queries above side by side, lags of the total and the peak hours, then filled forward.
_LAG_SQL = with_tables("SELECT UCP, FECHA, " + ", ".join(f"LAG({v}, {n}) OVER w AS {v.lower()}_lag_{n}d" for v, lags in (("TOTAL", E.LAGS), *[(p, E.PEAK_LAGS) for p in E.PEAK_HOURS]) for n in lags) + ", TOTAL - LAG(TOTAL) OVER w AS total_day_change, (TOTAL - LAG(TOTAL) OVER w) * 100.0 / NULLIF(LAG(TOTAL) OVER w, 0) AS total_day_change_pct FROM demand_hours WINDOW w AS (PARTITION BY UCP ORDER BY FECHA)", "demand_hours")
_names = lambda spec: [x.split(":")[0].strip() for x in spec.split(",")]
_FEATURES = [
    *_names(_CAL), *[f"{x}_{f}" for x in ("dayofweek", "month", "dayofyear") for f in ("sin", "cos")], "is_rainy_season", "is_january", "is_december", "week_of_month", "is_christmas_season", "is_post_season", "is_high_season", "days_since_holiday",
    *[f"{v.lower()}_lag_{n}d" for v, lags in (("TOTAL", E.LAGS), *[(p, E.PEAK_LAGS) for p in E.PEAK_HOURS]) for n in lags], "total_day_change", "total_day_change_pct", *[f"total_rolling_{n}_{w}d" for w, n, _ in _ROLL], *[f"total_lag_{n}y" for n in E.YEARS],
    *E.WEATHER_LAGS.values(), "temp_x_is_weekend", "temp_x_is_festivo", "humidity_x_is_weekend", "is_rainy_day", "dayofweek_x_festivo", "month_x_festivo", "weekend_x_month",
]
_FULL = "SELECT UCP, FECHA, " + ", ".join(f"COALESCE(LAST_VALUE(CAST({c} AS DOUBLE) IGNORE NULLS) OVER (PARTITION BY UCP ORDER BY FECHA ROWS UNBOUNDED PRECEDING), 0) AS {c}" for c in _FEATURES) + f" FROM ({_CAL_SQL}) c " + " ".join(f"JOIN ({x}) USING (UCP, FECHA)" for x in (_SEASON_SQL, _LAG_SQL, _ROLL_SQL, _ANNUAL_SQL, _WEATHER_SQL))
_OF = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(c, '{x}')" for x in E.GROUPS[g]) + f" THEN '{g}'" for g in ("interaction", "weather", "demand", "season")) + " ELSE 'calendar' END"


@R.add("features_full", "UCP, FECHA:s, " + ", ".join(f"{c}:r" for c in _FEATURES), _FULL)
def features_full(spark, sf):
    return E.build_features(_daily(spark, sf), _weather(spark, sf), KEYS)


@R.add("features_counts", "group, features:i, nulls:i", f"""SELECT {_OF} AS "group", COUNT(DISTINCT c) AS features, COUNT(*) FILTER (WHERE v IS NULL) AS nulls FROM ({_FULL}) UNPIVOT INCLUDE NULLS (v FOR c IN ({', '.join(_FEATURES)})) GROUP BY 1""")
def features_counts(spark, sf):
    d = _daily(spark, sf)
    f = E.build_features(d, _weather(spark, sf), KEYS)
    return E.feature_counts(f, E.feature_names(f, d.columns))


@R.add("features_model_input", "UCP, FECHA:s, TOTAL:r, total_lag_1y:r, temp_lag1d:r, columns:i", with_tables(f"SELECT f.UCP, f.FECHA, d.TOTAL, f.total_lag_1y, f.temp_lag1d, {len([c for c in _FEATURES if c not in E.DIRECT_LAGS])} AS columns FROM ({_FULL}) f JOIN demand d USING (UCP, FECHA)", "demand"))
def features_model_input(spark, sf):
    """Without direct lags, nulls as column means."""
    d = _daily(spark, sf)
    f = E.build_features(d, _weather(spark, sf), KEYS)
    names = E.feature_names(f, d.columns, lag_free=True)
    return E.fill_mean(f, names).withColumn("columns", F.lit(len(names)))


@R.add("calendar_classes", "UCP, FECHA:s, dia_semana, tipo_dia, es_festivo:b, nombre_festivo, es_fin_semana:b, temporada, mes:i, trimestre:i, dia_especial:b, dia_especial_reparto:b", with_tables("""SELECT d.UCP, d.FECHA, list_extract(['LUNES','MARTES','MIÉRCOLES','JUEVES','VIERNES','SÁBADO','DOMINGO'], CAST(isodow(d.FECHA) AS INT)) AS dia_semana, CASE WHEN h.FECHA IS NOT NULL THEN 'festivo' WHEN isodow(d.FECHA) > 5 THEN 'fin_de_semana' ELSE 'laboral' END AS tipo_dia, h.FECHA IS NOT NULL AS es_festivo, CASE WHEN h.FECHA IS NULL THEN 'No festivo' ELSE CASE strftime(d.FECHA, '%m-%d') WHEN '01-01' THEN 'Año Nuevo' WHEN '05-01' THEN 'Día del Trabajo' WHEN '07-20' THEN 'Día de la Independencia' WHEN '08-07' THEN 'Batalla de Boyacá' WHEN '12-08' THEN 'Inmaculada Concepción' WHEN '12-25' THEN 'Navidad' ELSE 'Festivo' END END AS nombre_festivo, isodow(d.FECHA) > 5 AS es_fin_semana, CASE WHEN month(d.FECHA) IN (4,5,9,10,11) THEN 'lluviosa' ELSE 'seca' END AS temporada, month(d.FECHA) AS mes, quarter(d.FECHA) AS trimestre, strftime(d.FECHA, '%m-%d') IN ('01-01','01-02','12-24','12-25','12-08') OR (h.FECHA IS NOT NULL AND strftime(d.FECHA, '%m-%d') IN ('05-01','07-20')) AS dia_especial, strftime(d.FECHA, '%m-%d') IN ('12-24','01-02') OR h.FECHA IS NOT NULL AS dia_especial_reparto FROM demand d LEFT JOIN holidays h ON h.UCP = d.UCP AND h.FECHA = d.FECHA""", "demand", "holidays"))
def calendar_classes(spark, sf):
    d = X.demand(spark, sf)
    return classify_days(d, X.holidays(d), KEYS)


