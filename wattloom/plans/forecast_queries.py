"""Registered queries over profiles, forecasts, base curves and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattloom import fixtures as X
from wattloom.fixtures import KEYS, recursive_with_tables, with_tables
from wattloom.functions.expressions import hours_array
from wattloom.operators import basecurve as B
from wattloom.operators import blocked as BL
from wattloom.operators import cleaning as C
from wattloom.operators import features as E
from wattloom.operators import forecast as F_
from wattloom.operators import metrics as M
from wattloom.operators import models as ML
from wattloom.operators import profiles as H
from wattloom.plans.shape import Registry
from wattloom.schema import HOURS
from wattloom.session import scratch, stored

R = Registry()
_A = "[" + ", ".join(HOURS) + "]"
_CHRISTMAS = "((month(FECHA) = 12 AND day(FECHA) >= 23) OR (month(FECHA) = 1 AND day(FECHA) <= 6))"


def _long(df, *cols, array="profile"):
    """An array of 24 as rows, so that both engines compare numbers."""
    return df.select(*cols, F.posexplode(array).alias("k", "value")).withColumn("periodo", F.col("k") + 1)


def _cluster(df):
    """A fixed assignment of days to clusters, to compare what follows from one."""
    return df.withColumn("cluster", (F.dayofmonth("FECHA") % 4).cast("int"))


# ---- profiles

_NORMAL = f"SELECT d.UCP, d.FECHA, UNNEST(range(1, 25)) AS periodo, UNNEST(list_transform({_A}, lambda x: x / list_sum({_A}))) AS value FROM demand_hours d JOIN (SELECT UCP AS u, MAX(FECHA) AS e FROM demand GROUP BY 1) ON UCP = u WHERE FECHA >= e - 90 AND NOT EXISTS (SELECT 1 FROM holidays h WHERE h.UCP = d.UCP AND h.FECHA = d.FECHA)"
_SPECIAL = f"SELECT d.UCP, d.FECHA, UNNEST(range(1, 25)) AS periodo, UNNEST(list_transform({_A}, lambda x: x / list_sum({_A}))) AS value FROM demand_hours d LEFT JOIN holidays h ON h.UCP = d.UCP AND h.FECHA = d.FECHA WHERE h.FECHA IS NOT NULL OR strftime(d.FECHA, '%m-%d') IN ('12-24', '01-02')"


def _normal(spark, sf):
    d = X.demand_hours(spark, sf)
    return H.normal_days(d, X.holidays(d), KEYS)


def _special(spark, sf):
    d = X.demand_hours(spark, sf)
    return H.special_days(d, X.holidays(d), KEYS)


@R.add("profiles_normal_days", "UCP, FECHA:s, periodo:i, value:r", with_tables(_NORMAL, "demand_hours", "holidays"))
def profiles_normal_days(spark, sf):
    return _long(_normal(spark, sf), "UCP", "FECHA")


@R.add("profiles_special_days", "UCP, FECHA:s, periodo:i, value:r", with_tables(_SPECIAL, "demand_hours", "holidays"))
def profiles_special_days(spark, sf):
    return _long(_special(spark, sf), "UCP", "FECHA")


@R.add("profiles_clusters", "UCP, cluster:i, periodo:i, value:r", with_tables(f"SELECT UCP, cluster, periodo, m / SUM(m) OVER (PARTITION BY UCP, cluster) AS value FROM (SELECT UCP, day(FECHA) % 4 AS cluster, periodo, AVG(value) AS m FROM ({_NORMAL}) GROUP BY 1, 2, 3)", "demand_hours", "holidays"))
def profiles_clusters(spark, sf):
    return _long(H.cluster_profiles(_cluster(_normal(spark, sf)), KEYS), "UCP", "cluster")


@R.add("profiles_cluster_by_weekday", "UCP, dow:i, cluster:i", with_tables("SELECT UCP, dow, cluster FROM (SELECT UCP, dow, cluster, ROW_NUMBER() OVER (PARTITION BY UCP, dow ORDER BY n DESC, cluster) AS k FROM (SELECT UCP, isodow(FECHA) - 1 AS dow, day(FECHA) % 4 AS cluster, COUNT(*) AS n FROM (SELECT d.* FROM demand d JOIN (SELECT UCP AS u, MAX(FECHA) AS e FROM demand GROUP BY 1) ON UCP = u WHERE FECHA >= e - 90 AND NOT EXISTS (SELECT 1 FROM holidays h WHERE h.UCP = d.UCP AND h.FECHA = d.FECHA)) GROUP BY 1, 2, 3)) WHERE k = 1", "demand", "holidays"))
def profiles_cluster_by_weekday(spark, sf):
    return H.cluster_by(_cluster(_normal(spark, sf)), KEYS, F.weekday("FECHA"), "dow")


@R.add("profiles_average_holiday", "UCP, periodo:i, value:r", with_tables(f"SELECT UCP, periodo, m / SUM(m) OVER (PARTITION BY UCP) AS value FROM (SELECT UCP, periodo, AVG(value) AS m FROM (SELECT *, MAX(year(FECHA)) OVER (PARTITION BY UCP) AS last FROM ({_SPECIAL})) WHERE year(FECHA) = last GROUP BY 1, 2)", "demand_hours", "holidays"))
def profiles_average_holiday(spark, sf):
    return _long(H.average_holiday_profile(_special(spark, sf), KEYS), "UCP")


@R.add("split_fallback", "UCP, FECHA:s, sum_hours:r, sum_valid:b, P1:r, P20:r", with_tables(f"SELECT UCP, FECHA, TOTAL AS sum_hours, TRUE AS sum_valid, TOTAL * 0.038 / {sum(H.FALLBACK)!r} AS P1, TOTAL * 0.048 / {sum(H.FALLBACK)!r} AS P20 FROM demand", "demand"))
def split_fallback(spark, sf):
    d = X.demand(spark, sf).withColumn("hours", H.scaled(H.fallback_profile(), F.col("TOTAL")))
    return H.check_sums(d).select("*", *H.wide(F.col("hours")))


@R.add("split_relevance", "UCP, FECHA:s, relevant:b, strict:b", with_tables("SELECT d.UCP, d.FECHA, d.FECHA BETWEEN e - 90 AND e + 30 AS relevant, d.FECHA BETWEEN e - 90 AND e AS strict FROM demand d JOIN (SELECT UCP AS u, MAX(FECHA) AS e FROM demand WHERE FECHA < DATE '2000-01-01' GROUP BY 1) ON UCP = u", "demand"))
def split_relevance(spark, sf):
    d = X.demand(spark, sf)
    ends = d.where("FECHA < '2000-01-01'").groupBy("UCP").agg(F.max("FECHA").alias("trained_to"))
    one = H.relevance(d.select("UCP", "FECHA"), ends, KEYS)
    return H.relevance(one.withColumnRenamed("relevant", "r").drop("trained_to"), ends, KEYS, strict=True).withColumnRenamed("relevant", "strict").withColumnRenamed("r", "relevant")


_SHARES = [f / sum(H.FALLBACK) for f in H.FALLBACK]


@R.add("metrics_sum_validity", "UCP, days:i, valid_pct:r, max_diff:r", with_tables(f"SELECT UCP, COUNT(*) AS days, AVG(CASE WHEN gap < 0.01 THEN 1.0 ELSE 0.0 END) * 100 AS valid_pct, MAX(gap) AS max_diff FROM (SELECT UCP, ABS(list_sum([TOTAL * f FOR f IN {_SHARES!r}]) - TOTAL) AS gap FROM demand) GROUP BY 1", "demand"))
def metrics_sum_validity(spark, sf):
    """Whether the hours that a split gives add up to the day's total, by key."""
    d = X.demand(spark, sf).withColumn("hours", H.scaled(H.fallback_profile(), F.col("TOTAL")))
    return M.sum_validity(H.check_sums(d), KEYS)


_REFIT = """SELECT k.UCP, k.asof, COUNT(h.FECHA) AS rows, COUNT(h.FECHA) >= 30 AND ABS(date_diff('day', ANY_VALUE(k.e), k.asof)) > 30 AS refit
FROM (SELECT d.UCP, ANY_VALUE(x.e) AS e, MIN(d.FECHA) AS asof FROM demand d JOIN (SELECT UCP, MAX(FECHA) AS e FROM demand WHERE FECHA < DATE '1997-01-01' GROUP BY 1) x ON x.UCP = d.UCP WHERE d.FECHA >= DATE '1997-01-01' AND NOT d.FECHA BETWEEN x.e - 90 AND x.e + 30 GROUP BY 1) k
LEFT JOIN demand h ON h.UCP = k.UCP AND h.FECHA <= k.asof GROUP BY k.UCP, k.asof"""


@R.add("split_refit", "UCP, asof:s, rows:i, refit:b", with_tables(_REFIT, "demand"))
def split_refit(spark, sf):
    """Profiles trained to the end of 1996 and asked for the days after: the first day past their reach, and whether to refit there."""
    d = X.demand(spark, sf)
    ends = d.where("FECHA < '1997-01-01'").groupBy("UCP").agg(F.max("FECHA").alias("trained_to"))
    done = ends.withColumnRenamed("trained_to", "refitted_at")
    return H.refit_needed(d.where("FECHA >= '1997-01-01'").select("UCP", "FECHA"), ends, d, KEYS, last_refit=done)


_CHAIN = """WITH RECURSIVE h AS (SELECT UCP, FECHA, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY FECHA) AS rows FROM demand),
s AS (SELECT UCP, 0 AS k, DATE '1995-01-05' AS trained_to, CAST(NULL AS DATE) AS FECHA, CAST(0 AS BIGINT) AS rows, FALSE AS refit FROM demand GROUP BY UCP
UNION ALL SELECT x.UCP, x.k, CASE WHEN h.rows >= 30 THEN h.FECHA ELSE x.trained_to END, h.FECHA, h.rows, h.rows >= 30 FROM (SELECT s.UCP, s.k + 1 AS k, s.trained_to, MIN(h.FECHA) AS next FROM s JOIN h ON h.UCP = s.UCP AND h.FECHA > COALESCE(s.FECHA + 30, DATE '1900-01-01') AND NOT h.FECHA BETWEEN s.trained_to - 90 AND s.trained_to + 30 GROUP BY 1, 2, 3) x JOIN h ON h.UCP = x.UCP AND h.FECHA = x.next)"""


def _chain(spark, sf):
    d = X.demand_hours(spark, sf)
    ends = d.select("UCP").distinct().withColumn("trained_to", F.to_date(F.lit("1995-01-05")))
    return d, X.holidays(d), H.refit_chain(d.select("UCP", "FECHA"), ends, d.select("UCP", "FECHA"), KEYS)


@R.add("split_refit_chain", "UCP, FECHA:s, rows:i, trained_to:s, refit:b", recursive_with_tables(_CHAIN + " SELECT UCP, FECHA, rows, trained_to, refit FROM s WHERE k > 0", "demand"))
def split_refit_chain(spark, sf):
    """Profiles trained to 5 January 1995, and every day of the history split in order: all tries to refit."""
    return _chain(spark, sf)[2]


@R.add("split_refit_days", "UCP, asof:s, days:i, p12:r", recursive_with_tables(_CHAIN + " SELECT s.UCP, s.FECHA AS asof, COUNT(*) AS days, AVG(d.P12 / d.TOTAL) AS p12 FROM s JOIN demand_hours d ON d.UCP = s.UCP AND d.FECHA BETWEEN s.trained_to - 90 AND s.trained_to WHERE s.refit AND NOT EXISTS (SELECT 1 FROM holidays y WHERE y.UCP = d.UCP AND y.FECHA = d.FECHA) GROUP BY 1, 2", "demand", "demand_hours", "holidays"))
def split_refit_days(spark, sf):
    """What each successful refit learns from: its normal days and their mean share of noon."""
    d, hol, chain = _chain(spark, sf)
    return H.refit_days(d, hol, chain, KEYS).groupBy("UCP", "asof").agg(F.count(F.lit(1)).alias("days"), F.avg(F.get("profile", F.lit(11))).alias("p12"))


@R.add("split_by_refits", "UCP, FECHA:s, asof:s, cluster_id:i, sum_valid:b, P1:r, P12:r, P24:r")
def split_by_refits(spark, sf):
    """All days of the history, each by the profiles that were in force on it."""
    d, hol, chain = _chain(spark, sf)
    return H.split_by_refits(d.select("UCP", "FECHA", "TOTAL"), d, hol, stored(chain, "chain"), KEYS)


def _model(spark, sf):
    d = X.demand_hours(spark, sf)
    return d, X.holidays(d), H.fit_hourly(d, X.holidays(d), KEYS)


@R.add("split_days", "UCP, FECHA:s, method, cluster_id:i, sum_hours:r, sum_valid:b, P1:r, P12:r, P24:r")
def split_days(spark, sf):
    """K-means profiles for every key, then all totals of the history to hours."""
    d, hol, model = _model(spark, sf)
    return H.split_days(d.select("UCP", "FECHA", "TOTAL"), model, hol, KEYS)


@R.add("split_special_list", "UCP, mmdd, cluster:i, nombre")
def split_special_list(spark, sf):
    return H.special_day_list(_model(spark, sf)[2], KEYS)


@R.add("profiles_pca", "UCP, FECHA:s, pc1:r, pc2:r, cluster:i")
def profiles_pca(spark, sf):
    return H.pca_view(X.demand_hours(spark, sf).select("UCP", "FECHA", *HOURS))[0]


# ---- k-means as rounds over all keys, and what follows from it

_SHARE = ", ".join(f"{h} / TOTAL" for h in HOURS)
_LOAD = {
    "normal": f"SELECT d.UCP, d.FECHA, [{_SHARE}] AS p FROM load_hours d JOIN (SELECT UCP AS u, MAX(FECHA) AS e FROM load_hours GROUP BY 1) ON UCP = u WHERE FECHA >= e - 90 AND NOT EXISTS (SELECT 1 FROM holidays h WHERE h.UCP = d.UCP AND h.FECHA = d.FECHA)",
    "special": f"SELECT d.UCP, d.FECHA, [{_SHARE}] AS p FROM load_hours d WHERE strftime(d.FECHA, '%m-%d') IN ('12-24', '01-02') OR EXISTS (SELECT 1 FROM holidays h WHERE h.UCP = d.UCP AND h.FECHA = d.FECHA)",
}
_ROUNDS = 50


def _lloyd_sql(t: str, clusters: int, starts: int = 4) -> str:
    """CTEs that end in {t}_fit (UCP, FECHA, p, cluster)."""
    mean = "[" + ", ".join(f"AVG(p[{k}])" for k in range(1, 25)) + "]"

    def near(centres: str) -> str:
        return f"SELECT d.UCP, c.s, d.FECHA, d.p, MIN({{'d': list_distance(d.p, c.c), 'j': c.j}}) AS b FROM {t}_days d JOIN {centres} c ON c.UCP = d.UCP GROUP BY ALL"

    return f"""{t}_days AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY FECHA) - 1 AS i, COUNT(*) OVER (PARTITION BY UCP) AS n FROM ({_LOAD[t]})),
{t}_lloyd AS (SELECT 0 AS r, d.UCP, s, j, d.p AS c FROM {t}_days d, (SELECT UNNEST(range({starts})) AS s), (SELECT UNNEST(range({clusters})) AS j) WHERE j < LEAST({clusters}, n) AND i = ((2 * {starts} * j + 2 * s + 1) * n) // (2 * {starts} * LEAST({clusters}, n))
UNION ALL SELECT x.r + 1, x.UCP, x.s, x.j, COALESCE(m.c, x.c) FROM {t}_lloyd x LEFT JOIN (SELECT UCP, s, b.j AS j, {mean} AS c FROM ({near(f"{t}_lloyd")}) GROUP BY 1, 2, 3) m ON m.UCP = x.UCP AND m.s = x.s AND m.j = x.j WHERE x.r < {_ROUNDS}),
{t}_near AS MATERIALIZED ({near(f"(SELECT * FROM {t}_lloyd WHERE r = {_ROUNDS})")}),
{t}_best AS (SELECT UCP, MIN({{'cost': cost, 's': s}}).s AS s FROM (SELECT UCP, s, ROUND(SUM(b.d * b.d), 12) AS cost FROM {t}_near GROUP BY 1, 2) GROUP BY 1),
{t}_mine AS (SELECT n.UCP, n.FECHA, n.p, MIN(n.FECHA) OVER (PARTITION BY n.UCP, n.b.j) AS first FROM {t}_near n JOIN {t}_best x ON x.UCP = n.UCP AND x.s = n.s),
{t}_fit AS MATERIALIZED (SELECT UCP, FECHA, p, DENSE_RANK() OVER (PARTITION BY UCP ORDER BY first) - 1 AS cluster FROM {t}_mine),
{t}_profiles AS (SELECT UCP, cluster, list_transform(m, lambda x: x / list_sum(m)) AS m FROM (SELECT UCP, cluster, {mean} AS m FROM {t}_fit GROUP BY 1, 2))"""


_NORMAL_FIT, _SPECIAL_FIT = "WITH RECURSIVE " + _lloyd_sql("normal", H.CLUSTERS_NORMAL), "WITH RECURSIVE " + _lloyd_sql("special", H.CLUSTERS_SPECIAL)
_MODE = "SELECT UCP, {n}, cluster FROM (SELECT UCP, {w} AS {n}, cluster, ROW_NUMBER() OVER (PARTITION BY UCP, {w} ORDER BY COUNT(*) DESC, cluster) AS k FROM {t}_fit GROUP BY 1, 2, 3) WHERE k = 1"
_BY_DOW = _MODE.format(n="dow", w="isodow(FECHA) - 1", t="normal")
_BY_MMDD = _MODE.format(n="mmdd", w="strftime(FECHA, '%m-%d')", t="special")


def _load(spark, sf):
    d = X.load_hours(spark, sf)
    return d, X.holidays(d)


def _normal_fit(spark, sf):
    return H.lloyd_clusters(H.normal_days(*_load(spark, sf), KEYS), KEYS, H.CLUSTERS_NORMAL)


def _special_fit(spark, sf):
    return H.lloyd_clusters(H.special_days(*_load(spark, sf), KEYS), KEYS, H.CLUSTERS_SPECIAL)


@R.add("profiles_kmeans", "UCP, FECHA:s, cluster:i", recursive_with_tables(_NORMAL_FIT + " SELECT UCP, FECHA, cluster FROM normal_fit", "load_hours", "holidays"))
def profiles_kmeans(spark, sf):
    """The cluster of each normal day of the last 90, fitted."""
    return _normal_fit(spark, sf)


@R.add("profiles_kmeans_special", "UCP, FECHA:s, cluster:i", recursive_with_tables(_SPECIAL_FIT + " SELECT UCP, FECHA, cluster FROM special_fit", "load_hours", "holidays"))
def profiles_kmeans_special(spark, sf):
    """The cluster of each special day of the history, fitted."""
    return _special_fit(spark, sf)


@R.add("profiles_kmeans_clusters", "UCP, cluster:i, periodo:i, value:r", recursive_with_tables(_NORMAL_FIT + " SELECT UCP, cluster, UNNEST(range(1, 25)) AS periodo, UNNEST(m) AS value FROM normal_profiles", "load_hours", "holidays"))
def profiles_kmeans_clusters(spark, sf):
    return _long(H.cluster_profiles(_normal_fit(spark, sf), KEYS), "UCP", "cluster")


@R.add("profiles_kmeans_by_weekday", "UCP, dow:i, cluster:i", recursive_with_tables(f"{_NORMAL_FIT} {_BY_DOW}", "load_hours", "holidays"))
def profiles_kmeans_by_weekday(spark, sf):
    return H.cluster_by(_normal_fit(spark, sf), KEYS, F.weekday("FECHA"), "dow")


@R.add("profiles_kmeans_by_mmdd", "UCP, mmdd, cluster:i", recursive_with_tables(f"{_SPECIAL_FIT} {_BY_MMDD}", "load_hours", "holidays"))
def profiles_kmeans_by_mmdd(spark, sf):
    return H.cluster_by(_special_fit(spark, sf), KEYS, H.mmdd("FECHA"), "mmdd")


_SPLIT = f"""{_NORMAL_FIT}, {_lloyd_sql("special", H.CLUSTERS_SPECIAL)},
average AS (SELECT UCP, list_transform(m, lambda x: x / list_sum(m)) AS m FROM (SELECT UCP, [{", ".join(f"AVG(p[{k}])" for k in range(1, 25))}] AS m FROM (SELECT *, MAX(year(FECHA)) OVER (PARTITION BY UCP) AS y FROM special_fit) WHERE year(FECHA) = y GROUP BY 1)),
t AS (SELECT d.UCP, d.FECHA, d.TOTAL, strftime(d.FECHA, '%m-%d') IN ('12-24', '01-02') OR EXISTS (SELECT 1 FROM holidays h WHERE h.UCP = d.UCP AND h.FECHA = d.FECHA) AS special FROM load_hours d),
j AS (SELECT t.*, CASE WHEN special THEN COALESCE(b.cluster, -1) ELSE COALESCE(a.cluster, 0) END AS cluster_id, CASE WHEN special THEN COALESCE(q.m, v.m) ELSE p.m END AS m FROM t
LEFT JOIN ({_BY_DOW}) a ON a.UCP = t.UCP AND a.dow = isodow(t.FECHA) - 1 LEFT JOIN normal_profiles p ON p.UCP = t.UCP AND p.cluster = COALESCE(a.cluster, 0)
LEFT JOIN ({_BY_MMDD}) b ON b.UCP = t.UCP AND b.mmdd = strftime(t.FECHA, '%m-%d') LEFT JOIN special_profiles q ON q.UCP = t.UCP AND q.cluster = b.cluster LEFT JOIN average v ON v.UCP = t.UCP),
s AS (SELECT UCP, FECHA, TOTAL, cluster_id, CASE WHEN m IS NULL THEN 'fallback' WHEN special THEN 'special' ELSE 'normal' END AS method, list_transform(COALESCE(m, {_SHARES!r}), lambda x: x * TOTAL) AS hours FROM j)"""


def _load_split(spark, sf):
    d, hol = _load(spark, sf)
    return H.split_days(d.select("UCP", "FECHA", "TOTAL"), H.fit_hourly(d, hol, KEYS, lloyd=True), hol, KEYS)


@R.add("split_kmeans", "UCP, FECHA:s, method, cluster_id:i, sum_hours:r, sum_valid:b, " + ", ".join(f"{h}:r" for h in HOURS), recursive_with_tables(_SPLIT + " SELECT UCP, FECHA, method, cluster_id, list_sum(hours) AS sum_hours, ABS(list_sum(hours) - TOTAL) < 0.01 AS sum_valid, " + ", ".join(f"hours[{k}] AS P{k}" for k in range(1, 25)) + " FROM s", "load_hours", "holidays"))
def split_kmeans(spark, sf):
    """All totals of the history to hours by the fitted profiles."""
    return _load_split(spark, sf)


@R.add("metrics_split_validity", "UCP, days:i, valid_pct:r", recursive_with_tables(_SPLIT + " SELECT UCP, COUNT(*) AS days, AVG(CASE WHEN ABS(list_sum(hours) - TOTAL * (CASE WHEN day(FECHA) = 13 THEN 1.01 ELSE 1 END)) < 0.01 THEN 100.0 ELSE 0.0 END) AS valid_pct FROM s GROUP BY 1", "load_hours", "holidays"))
def metrics_split_validity(spark, sf):
    """How many days' hours add up to a reported total that is 1 % off on the 13th of each month."""
    d = _load_split(spark, sf)
    off = d.withColumn("TOTAL", F.col("TOTAL") * F.when(F.dayofmonth("FECHA") == 13, 1.01).otherwise(1.0))
    return M.sum_validity(H.check_sums(off.drop("sum_hours", "sum_diff", "sum_error_pct", "sum_valid")), KEYS)


# ---- forecast


@R.add("forecast_horizon", "UCP, last_day:s, FECHA:s", with_tables("SELECT UCP, e AS last_day, e + CAST(k AS INT) AS FECHA FROM (SELECT UCP, MAX(FECHA) AS e FROM demand GROUP BY 1), (SELECT UNNEST(range(1, 31)) AS k)", "demand"))
def forecast_horizon(spark, sf):
    return F_.horizon(X.demand(spark, sf), 30, KEYS)


_AS_OF = with_tables("SELECT t.UCP, t.FECHA, t.at, COALESCE(d.TOTAL, f.first, 0) AS TOTAL FROM (SELECT UCP, FECHA, FECHA - 400 AS at FROM demand) t ASOF LEFT JOIN demand d ON d.UCP = t.UCP AND d.FECHA <= t.at LEFT JOIN (SELECT UCP, ARG_MIN(TOTAL, FECHA) AS first FROM demand GROUP BY 1) f ON f.UCP = t.UCP", "demand")


@R.add("forecast_as_of", "UCP, FECHA:s, at:s, TOTAL:r", _AS_OF)
def forecast_as_of(spark, sf):
    d = X.demand(spark, sf)
    return F_.as_of(d.select("UCP", "FECHA", F.date_sub("FECHA", 400).alias("at")), d, KEYS, "at", ["TOTAL"])


@R.add("forecast_as_of_blocks", "UCP, FECHA:s, at:s, TOTAL:r", _AS_OF)
def forecast_as_of_blocks(spark, sf):
    """The same by key and month."""
    d = X.demand(spark, sf)
    return BL.as_of(d.select("UCP", "FECHA", F.date_sub("FECHA", 400).alias("at")), d, KEYS, "at", ["TOTAL"])


_TIER = "CASE WHEN n{n}a >= {m} THEN {s}{n}a WHEN n{n}b >= 3 THEN {s}{n}b ELSE {s}{n}c END"
_ANCHOR = "SELECT UCP, " + ", ".join(f"COUNT(*) FILTER (WHERE {c}) AS n{n}{t}, " + ", ".join(f"{f}(TOTAL) FILTER (WHERE {c}) AS {s}{n}{t}" for s, f in (("mean", "AVG"), ("std", "STDDEV_POP"), ("min", "MIN"), ("max", "MAX"))) for n in (7, 14, 28) for t, c in (("a", f"ago < {n} AND ok"), ("b", f"ago < {2 * n} AND ok"), ("c", f"ago < {n}"))) + f" FROM (SELECT *, e - FECHA AS ago, NOT {_CHRISTMAS} AS ok FROM (SELECT *, MAX(FECHA) OVER (PARTITION BY UCP) AS e FROM demand WHERE FECHA <= DATE '2000-01-08')) GROUP BY UCP"


@R.add("forecast_anchored_rolling", "UCP, " + ", ".join(f"total_rolling_{s}_{n}d:r" for n in (7, 14, 28) for s in ("mean", "std", "min", "max")), with_tables("SELECT UCP, " + ", ".join(_TIER.format(n=n, m=max(3, n // 2), s=s) + f" AS total_rolling_{s}_{n}d" for n in (7, 14, 28) for s in ("mean", "std", "min", "max")) + f" FROM ({_ANCHOR})", "demand"))
def forecast_anchored_rolling(spark, sf):
    """The history ends inside Christmas season, so that the wider windows are met."""
    return F_.anchored_rolling(X.demand(spark, sf).where("FECHA <= '2000-01-08'"), KEYS)


_NORMALS = {"temp_mean": 22.0, "rain_sum": 0.0}


@R.add("forecast_climate_normals", "UCP, month:i, temp_mean:r, rain_sum:r", with_tables("SELECT r_name AS UCP, k AS month, COALESCE(NULLIF(t, 0), 22.0) AS temp_mean, COALESCE(NULLIF(s, 0), 0.0) AS rain_sum FROM region CROSS JOIN (SELECT UNNEST(range(1, 13)) AS k) LEFT JOIN (SELECT UCP, month(FECHA) AS m, AVG(temp_mean) AS t, AVG(rain_sum) AS s FROM weather GROUP BY 1, 2) ON UCP = r_name AND m = k", "weather"))
def forecast_climate_normals(spark, sf):
    return F_.climate_normals(C.weather_daily(X.weather_hours(spark, sf), KEYS), KEYS, _NORMALS)


@R.add("forecast_climate", "UCP, FECHA:s, temp_mean:r, rain_sum:r, climate_source", with_tables("SELECT h.UCP, h.FECHA, COALESCE(w.temp_mean, NULLIF(n.t, 0), 22.0) AS temp_mean, COALESCE(w.rain_sum, NULLIF(n.s, 0), 0.0) AS rain_sum, CASE WHEN w.UCP IS NULL THEN 'normals' ELSE 'real' END AS climate_source FROM (SELECT UCP, e + CAST(k AS INT) AS FECHA FROM (SELECT UCP, MAX(FECHA) AS e FROM demand GROUP BY 1), (SELECT UNNEST(range(1, 31)) AS k)) h LEFT JOIN weather w ON w.UCP = h.UCP AND w.FECHA = h.FECHA LEFT JOIN (SELECT UCP, month(FECHA) AS m, AVG(temp_mean) AS t, AVG(rain_sum) AS s FROM weather GROUP BY 1, 2) n ON n.UCP = h.UCP AND n.m = month(h.FECHA)", "demand", "weather"))
def forecast_climate(spark, sf):
    w = C.weather_daily(X.weather_hours(spark, sf), KEYS)
    return F_.climate_for(F_.horizon(X.demand(spark, sf), 30, KEYS), w, KEYS, _NORMALS)


_ADJ = "CASE WHEN strftime(FECHA, '%m-%d') IN ('12-24','12-25','12-08','01-01','01-02') THEN 0.7 WHEN hol THEN 0.6 WHEN " + _CHRISTMAS + " AND isodow(FECHA) > 5 THEN 0.6 END"


@R.add("forecast_adjust", "UCP, FECHA:s, demanda_predicha:r, adjusted:b", with_tables(f"SELECT UCP, FECHA, CASE WHEN w IS NOT NULL AND y > 0 THEN w * y + (1 - w) * pred ELSE pred END AS demanda_predicha, COALESCE(w IS NOT NULL AND y > 0, FALSE) AS adjusted FROM (SELECT *, {_ADJ} AS w FROM (SELECT n.UCP, n.FECHA, n.pred, d.TOTAL AS y, h.FECHA IS NOT NULL AS hol FROM naive n LEFT JOIN demand d ON d.UCP = n.UCP AND d.FECHA = n.FECHA - INTERVAL 1 YEAR LEFT JOIN holidays h ON h.UCP = n.UCP AND h.FECHA = n.FECHA))", "naive", "demand", "holidays"))
def forecast_adjust(spark, sf):
    from wattloom.functions.calendar import holiday_flags

    d = X.demand(spark, sf)
    past = d.select("UCP", F.col("FECHA").alias("__at"), F.col("TOTAL").alias("total_lag_1y"))
    n = X.naive_forecast(d).withColumn("__at", F.add_months("FECHA", -12)).join(past, ["UCP", "__at"], "left")
    return F_.adjust(holiday_flags(n.withColumnRenamed("pred", "demanda_predicha"), X.holidays(d), KEYS))


@R.add("forecast_summary", "UCP, days:i, first_day:s, last_day:s, mean:r, min:r, max:r, working_days:i, weekend_days:i, holidays:i", with_tables("SELECT n.UCP, COUNT(*) AS days, MIN(n.FECHA) AS first_day, MAX(n.FECHA) AS last_day, AVG(pred) AS mean, MIN(pred) AS min, MAX(pred) AS max, COUNT(*) FILTER (WHERE isodow(n.FECHA) <= 5 AND h.FECHA IS NULL) AS working_days, COUNT(*) FILTER (WHERE isodow(n.FECHA) > 5 AND h.FECHA IS NULL) AS weekend_days, COUNT(h.FECHA) AS holidays FROM naive n LEFT JOIN holidays h ON h.UCP = n.UCP AND h.FECHA = n.FECHA GROUP BY 1", "naive", "holidays"))
def forecast_summary(spark, sf):
    from wattloom.functions.calendar import holiday_flags

    d = X.demand(spark, sf)
    return F_.summary(holiday_flags(X.naive_forecast(d), X.holidays(d), KEYS), KEYS, "FECHA", "pred")


@R.add("forecast_output", "UCP, fecha:s, dia_semana, demanda_predicha, es_festivo:b, metodo_desagregacion", with_tables("SELECT n.UCP, n.FECHA AS fecha, list_extract(['LUNES','MARTES','MIÉRCOLES','JUEVES','VIERNES','SÁBADO','DOMINGO'], CAST(isodow(n.FECHA) AS INT)) AS dia_semana, ROUND(pred * 1.037137, 2) AS demanda_predicha, h.FECHA IS NOT NULL AS es_festivo, CASE WHEN h.FECHA IS NOT NULL THEN 'special' ELSE 'normal' END AS metodo_desagregacion FROM naive n LEFT JOIN holidays h ON h.UCP = n.UCP AND h.FECHA = n.FECHA", "naive", "holidays"))
def forecast_output(spark, sf):
    from wattloom.functions.calendar import holiday_flags

    d = X.demand(spark, sf)
    n = holiday_flags(X.naive_forecast(d).withColumnRenamed("pred", "demanda_predicha"), X.holidays(d), KEYS)
    return F_.output_rows(F_.apply_offset(n, 1.037137), KEYS)


@R.add("forecast_backtest", "UCP, FECHA:s, real:r, pred:r, abs_error_pct:r", with_tables("SELECT t.UCP, t.FECHA, d.TOTAL AS real, p.TOTAL AS pred, ABS((p.TOTAL - d.TOTAL) * 100.0 / d.TOTAL) AS abs_error_pct FROM (SELECT UCP, e - 30 + CAST(k AS INT) AS FECHA, e - 30 AS cut FROM (SELECT UCP, MAX(FECHA) AS e FROM demand GROUP BY 1), (SELECT UNNEST(range(1, 31)) AS k)) t JOIN demand d ON d.UCP = t.UCP AND d.FECHA = t.FECHA ASOF JOIN (SELECT * FROM demand) p ON p.UCP = t.UCP AND p.FECHA <= t.FECHA - 365", "demand"))
def forecast_backtest(spark, sf):
    """The last 30 days held out; the model is the as-of value of a year before."""
    train, actual = F_.backtest_frame(X.demand(spark, sf), KEYS)
    last = X.demand(spark, sf).groupBy("UCP").agg(F.date_sub(F.max("FECHA"), 30).alias("__cut"))
    days = last.select("UCP", F.explode(F.sequence(F.date_add("__cut", 1), F.date_add("__cut", 30))).alias("FECHA"))
    pred = F_.as_of(days.withColumn("at", F.date_sub("FECHA", 365)), train, KEYS, "at", ["TOTAL"]).withColumnRenamed("TOTAL", "pred")
    return M.with_errors(F_.with_actuals(pred, actual, KEYS), "real", "pred")


def _inputs(spark, sf):
    """(demand by hours, daily weather), each written once: a row a key and day, which features and forecasts look up
    many times, where each lookup would else aggregate the orders and line items again."""
    return stored(X.demand_hours(spark, sf), "demand"), stored(C.weather_daily(X.weather_hours(spark, sf), KEYS), "weather")


def _serving(d, w, n=30):
    d = d.select("UCP", "FECHA", "TOTAL", "P8", "P12", "P18", "P20")
    return F_.serving_features(d, w, X.holidays(d), KEYS, n)


_ASKS = {**{f"b{n}": f"FECHA - {n}" for n in (1, 7, 14)}, **{f"y{n}": f"CAST(FECHA - INTERVAL {n} YEAR AS DATE)" for n in (1, 2, 3)}, **{f"d{n}": f"FECHA - {365 * n}" for n in (1, 2, 3)}}
_MEANS = {n: _TIER.format(n=n, m=max(3, n // 2), s="mean") for n in (7, 14, 28)}
_SERVED = f"""WITH h AS (SELECT UCP, FECHA, {', '.join(f'{at} AS at_{k}' for k, at in _ASKS.items())} FROM (SELECT UCP, e + CAST(k AS INT) AS FECHA FROM (SELECT UCP, MAX(FECHA) AS e FROM demand GROUP BY 1), (SELECT UNNEST(range(1, 31)) AS k))),
firsts AS (SELECT UCP, ARG_MIN(TOTAL, FECHA) AS total, ARG_MIN(P8, FECHA) AS p8, ARG_MAX(TOTAL, FECHA) AS latest FROM demand_hours GROUP BY 1),
lags AS (SELECT h.UCP, h.FECHA, {', '.join(f'COALESCE({k}.TOTAL, f.total, 0) AS {k}' for k in _ASKS)}, COALESCE(b7.P8, f.p8, 0) AS p8_b7, f.latest FROM h LEFT JOIN firsts f ON f.UCP = h.UCP {' '.join(f'ASOF LEFT JOIN demand_hours {k} ON {k}.UCP = h.UCP AND {k}.FECHA <= h.at_{k}' for k in _ASKS)}),
same AS (SELECT h.UCP, h.FECHA, AVG(d.TOTAL) AS same_day_mean FROM h JOIN demand d ON d.UCP = h.UCP AND strftime(d.FECHA, '%m-%d') = strftime(h.FECHA, '%m-%d') AND d.FECHA < h.FECHA GROUP BY 1, 2),
anchor AS ({_ANCHOR.replace(" WHERE FECHA <= DATE '2000-01-08'", "")}), off AS (SELECT d.UCP, MAX(d.FECHA) AS last_off FROM demand d JOIN holidays x ON x.UCP = d.UCP AND x.FECHA = d.FECHA GROUP BY 1),
normals AS (SELECT UCP, month(FECHA) AS m, AVG(temp_mean) AS t FROM weather GROUP BY 1, 2)
SELECT l.UCP, l.FECHA, b1 AS total_lag_1d, b7 AS total_lag_7d, b14 AS total_lag_14d, p8_b7 AS p8_lag_7d, {', '.join(f'CASE WHEN y{n} <> 0 THEN y{n} ELSE COALESCE(same_day_mean, NULLIF(d{n}, 0), b1) END AS total_lag_{n}y' for n in (1, 2, 3))},
COALESCE({_MEANS[7]}, latest) AS total_rolling_mean_7d, COALESCE({_MEANS[28]}, {_MEANS[14]}, {_MEANS[7]}, latest) AS total_rolling_mean_28d, b1 - b7 AS total_day_change, CASE WHEN b7 <> 0 THEN (b1 - b7) * 100.0 / b7 ELSE 0 END AS total_day_change_pct, COALESCE(w.temp_mean, NULLIF(n.t, 0), 22.0) AS temp_lag1d,
LEAST(30, COALESCE(l.FECHA - last_off, 30)) AS days_since_holiday, x.FECHA IS NOT NULL AS is_festivo
FROM lags l LEFT JOIN same s ON s.UCP = l.UCP AND s.FECHA = l.FECHA LEFT JOIN anchor a ON a.UCP = l.UCP LEFT JOIN off o ON o.UCP = l.UCP LEFT JOIN weather w ON w.UCP = l.UCP AND w.FECHA = l.FECHA LEFT JOIN normals n ON n.UCP = l.UCP AND n.m = month(l.FECHA) LEFT JOIN holidays x ON x.UCP = l.UCP AND x.FECHA = l.FECHA"""
_SERVED_TABLES = ("demand_hours", "weather", "holidays")
_WEIGHT = f"CASE WHEN strftime(FECHA, '%m-%d') IN ({', '.join(repr(x) for x in F_.VERY_SPECIAL)}) THEN 0.7 WHEN is_festivo OR ({_CHRISTMAS} AND isodow(FECHA) > 5) THEN 0.6 END"


@R.add("forecast_serving_features", "UCP, FECHA:s, total_lag_1d:r, total_lag_7d:r, total_lag_14d:r, p8_lag_7d:r, total_lag_1y:r, total_lag_2y:r, total_lag_3y:r, total_rolling_mean_7d:r, total_rolling_mean_28d:r, total_day_change:r, total_day_change_pct:r, temp_lag1d:r, days_since_holiday:i, is_festivo:i", with_tables(_SERVED, *_SERVED_TABLES))
def forecast_serving_features(spark, sf):
    return _serving(*_inputs(spark, sf))


@R.add("forecast_direct", "UCP, FECHA:s, demanda_predicha:r, predicted_raw:r, adjusted:b", with_tables(f"WITH served AS ({_SERVED}) SELECT UCP, FECHA, raw AS predicted_raw, w IS NOT NULL AND total_lag_1y > 0 AS adjusted, CASE WHEN w IS NOT NULL AND total_lag_1y > 0 THEN w * total_lag_1y + (1 - w) * raw ELSE raw END AS demanda_predicha FROM (SELECT *, (total_lag_1y + total_rolling_mean_28d) / 2 AS raw, {_WEIGHT} AS w FROM served)", *_SERVED_TABLES))
def forecast_direct(spark, sf):
    """All horizon days at once, with a lag-free blend of last year and the recent mean as the model."""
    return F_.forecast_direct(_serving(*_inputs(spark, sf)), lambda f: f.withColumn("demanda_predicha", (F.col("total_lag_1y") + F.col("total_rolling_mean_28d")) / 2))


_LINEAR = {"total_lag_1d": 0.5, "total_lag_7d": 0.25, "total_lag_14d": 0.15, "total_lag_1y": 0.1}
#: A state of 14 as-of totals a key, moved on day by day.
_RECURSIVE = """WITH RECURSIVE ends AS (SELECT UCP, MAX(FECHA) AS e, ARG_MIN(TOTAL, FECHA) AS first FROM demand GROUP BY 1),
back AS (SELECT t.UCP, t.k, COALESCE(d.TOTAL, t.first) AS v FROM (SELECT UCP, first, k, e - CAST(k AS INT) AS at FROM ends, (SELECT UNNEST(range(0, 14)) AS k)) t ASOF LEFT JOIN demand d ON d.UCP = t.UCP AND d.FECHA <= t.at),
year_ago AS (SELECT t.UCP, t.k, COALESCE(d.TOTAL, t.first) AS y, h.FECHA IS NOT NULL AS hol, t.FECHA FROM (SELECT UCP, first, k, e + CAST(k AS INT) AS FECHA, CAST(e + CAST(k AS INT) - INTERVAL 1 YEAR AS DATE) AS at FROM ends, (SELECT UNNEST(range(1, 31)) AS k)) t ASOF LEFT JOIN demand d ON d.UCP = t.UCP AND d.FECHA <= t.at LEFT JOIN holidays h ON h.UCP = t.UCP AND h.FECHA = t.FECHA),
weighted AS (SELECT *, {adj} AS w FROM year_ago),
s AS (SELECT UCP, CAST(0 AS BIGINT) AS k, list(v ORDER BY k DESC) AS r FROM back GROUP BY UCP
UNION ALL SELECT x.UCP, x.k, list_concat(x.r[2:14], [CASE WHEN x.w IS NOT NULL AND x.y > 0 THEN x.w * x.y + (1 - x.w) * x.p ELSE x.p END]) FROM (SELECT s.UCP, q.k, s.r, q.w, q.y, 0.5 * s.r[14] + 0.25 * s.r[8] + 0.15 * s.r[1] + 0.1 * q.y AS p FROM s JOIN weighted q ON q.UCP = s.UCP AND q.k = s.k + 1) x)
SELECT s.UCP, q.FECHA, s.r[14] AS demanda_predicha FROM s JOIN weighted q ON q.UCP = s.UCP AND q.k = s.k""".format(adj=_ADJ)


@R.add("forecast_recursive_linear", "UCP, FECHA:s, demanda_predicha:r", recursive_with_tables(_RECURSIVE, "demand", "holidays"))
def forecast_recursive_linear(spark, sf):
    """Thirty days, one after another, by a linear model of lags that are forecasts themselves from the second day on."""
    d, w = stored(X.demand(spark, sf), "demand"), stored(C.weather_daily(X.weather_hours(spark, sf), KEYS), "weather")
    model = lambda f: f.withColumn("demanda_predicha", sum(F.col(c) * x for c, x in _LINEAR.items()))
    return F_.forecast_recursive(d, w, X.holidays(d), KEYS, 30, model)


@R.add("forecast_recursive_trained", "UCP, FECHA:s, demanda_predicha:r, method, P1:r, P12:r, P24:r, sum_valid:b")
def forecast_recursive_trained(spark, sf):
    """End to end: boosted trees trained on lags, thirty days forecast one after another, and split into hours."""
    d, w = _inputs(spark, sf)
    hol = X.holidays(d)
    s, names = _training(d, w, lag_free=False)
    served = F_.recursive_features(F_.recursive_state(d, w, hol, KEYS, 1)).columns
    model = ML.train(s.where("split = 'train'"), [c for c in names if c in served], models={"boosted_flat": ML.estimators()["boosted_flat"]})["boosted_flat"]
    f = F_.forecast_recursive(d, w, hol, KEYS, 30, lambda x: ML.score(model, x.fillna(0, model.stages[0].getInputCols())))
    return H.split_days(f.withColumnRenamed("demanda_predicha", "TOTAL"), H.fit_hourly(d, hol, KEYS), hol, KEYS).withColumnRenamed("TOTAL", "demanda_predicha")


# ---- base curves


def _curve_inputs(spark, sf):
    d = X.demand_hours(spark, sf)
    hol = X.holidays(d)
    t = B.targets(d, "2000-11-20", "2001-01-20", hol, KEYS)
    return d, hol, t, B.history_of(d, hol, KEYS)


_T = "SELECT r_name AS UCP, CAST(DATE '2000-11-20' + CAST(k AS INT) AS DATE) AS FECHA FROM region, (SELECT UNNEST(range(0, 62)) AS k)"
_HIST = "SELECT d.UCP, d.FECHA, d.TOTAL, h.FECHA IS NOT NULL AS hol FROM demand d LEFT JOIN holidays h ON h.UCP = d.UCP AND h.FECHA = d.FECHA"


@R.add("curve_targets", "UCP, FECHA:s, dow:i, mmdd, route", with_tables(f"SELECT t.UCP, t.FECHA, isodow(t.FECHA) - 1 AS dow, strftime(t.FECHA, '%m-%d') AS mmdd, CASE WHEN {_CHRISTMAS.replace('FECHA', 't.FECHA')} THEN 'christmas' WHEN h.FECHA IS NOT NULL THEN 'holiday' ELSE 'normal' END AS route FROM ({_T}) t LEFT JOIN holidays h ON h.UCP = t.UCP AND h.FECHA = t.FECHA", "holidays"))
def curve_targets(spark, sf):
    return _curve_inputs(spark, sf)[2]


@R.add("curve_same_day", "UCP, FECHA:s, h_date:s, h_total:r, n:i", with_tables(f"SELECT * FROM (SELECT t.UCP, t.FECHA, d.FECHA AS h_date, d.TOTAL AS h_total, ROW_NUMBER() OVER (PARTITION BY t.UCP, t.FECHA ORDER BY d.FECHA DESC) AS n FROM ({_T}) t JOIN demand d ON d.UCP = t.UCP AND month(d.FECHA) = month(t.FECHA) AND day(d.FECHA) = day(t.FECHA) AND d.FECHA < t.FECHA) WHERE n <= 5", "demand"))
def curve_same_day(spark, sf):
    _, _, t, h = _curve_inputs(spark, sf)
    return B.same_day(t, h, KEYS)


@R.add("curve_recent", "UCP, FECHA:s, recent_dow:r, recent_all:r", with_tables(f"SELECT t.UCP, t.FECHA, AVG(d.TOTAL) FILTER (WHERE isodow(d.FECHA) = isodow(t.FECHA)) AS recent_dow, AVG(d.TOTAL) AS recent_all FROM ({_T}) t JOIN ({_HIST}) d ON d.UCP = t.UCP AND NOT d.hol AND d.FECHA < t.FECHA AND d.FECHA >= t.FECHA - 60 GROUP BY 1, 2", "demand", "holidays"))
def curve_recent(spark, sf):
    _, _, t, h = _curve_inputs(spark, sf)
    return B.recent_stats(t, h, KEYS)


_J = f"SELECT t.UCP, t.FECHA, d.FECHA AS h, d.TOTAL FROM ({_T}) t JOIN ({_HIST}) d ON d.UCP = t.UCP AND NOT d.hol AND isodow(d.FECHA) = isodow(t.FECHA) AND d.FECHA < t.FECHA"
_TIERS = [
    "date_trunc('month', h) = date_trunc('month', FECHA - INTERVAL 1 MONTH)", "date_trunc('month', h) = date_trunc('month', FECHA)", "h >= FECHA - INTERVAL 2 MONTH", "month(h) = month(FECHA) AND h >= FECHA - INTERVAL 2 YEAR",
]


@R.add("curve_normal_tiers", "UCP, FECHA:s, tier:i, tier_total:r", with_tables("SELECT UCP, FECHA, tier, tier_total FROM (SELECT UCP, FECHA, tier, AVG(TOTAL) AS tier_total, ROW_NUMBER() OVER (PARTITION BY UCP, FECHA ORDER BY tier) AS k FROM (" + " UNION ALL ".join(f"SELECT UCP, FECHA, {n + 1} AS tier, TOTAL FROM ({_J}) WHERE {c}" for n, c in enumerate(_TIERS)) + f" UNION ALL SELECT t.UCP, t.FECHA, 5, d.TOTAL FROM ({_T}) t JOIN ({_HIST}) d ON d.UCP = t.UCP AND NOT d.hol AND d.FECHA >= t.FECHA - INTERVAL 2 YEAR) GROUP BY 1, 2, 3) WHERE k = 1", "demand", "holidays"))
def curve_normal_tiers(spark, sf):
    _, _, t, h = _curve_inputs(spark, sf)
    return B.normal_tiers(t, h, KEYS)


_SHOWN = ["P1", "P12", "P24"]
_LATE = "((month(FECHA) = 12 AND day(FECHA) >= 28) OR month(FECHA) = 1)"
_BLEND = f"CASE WHEN isodow(FECHA) <= 5 AND recent_dow IS NOT NULL THEN CASE WHEN {_LATE} THEN total3 * 0.6 + recent_dow * 0.4 ELSE total3 * 0.5 + recent_dow * 0.5 END WHEN isodow(FECHA) <= 5 THEN total3 * CASE WHEN {_LATE} THEN 1.10 ELSE 1.08 END ELSE total3 * CASE WHEN {_LATE} THEN 1.05 ELSE 1.03 END END"
#: For each hour shown: the aggregates of same days, of a month's holidays and of tiers, and the rules in their order.
_SAME_AGG = ", ".join(f"AVG({p} / s) FILTER (WHERE n <= 2) AS two_{p}, AVG({p} / s) FILTER (WHERE n <= 3) AS three_{p}, AVG({p}) AS five_{p}" for p in _SHOWN)
_RULES = [
    ("'same_day'", "route = 'christmas' AND same_n > 0 AND strftime(FECHA, '%m-%d') IN ('12-25', '01-01')", "two_{p} * total2"), ("'christmas_history'", "route = 'christmas' AND same_n > 0", "three_{p} * (" + _BLEND + ")"),
    ("'flat'", "route = 'christmas'", "COALESCE(recent_all, g_total) / 24"), ("'same_day'", "route = 'holiday' AND same_n > 0", "five_{p}"), ("'holiday_month'", "route = 'holiday' AND hol_total IS NOT NULL", "hol_{p} * hol_total"),
    ("'flat'", "route = 'holiday'", "g_total / 24"), ("'tier_' || tier", "TRUE", "tier_{p}"),
]
_case = lambda value: "CASE " + " ".join(f"WHEN {cond} THEN {value(name, v)}" for name, cond, v in _RULES) + " END"
_FAR = "SELECT t.UCP, t.FECHA, {tier} AS tier, d.tot, {cols} FROM t JOIN hist d ON d.UCP = t.UCP AND {cond}"
_OF_DAY = [*[f"NOT d.hol AND isodow(d.FECHA) = isodow(t.FECHA) AND d.FECHA < t.FECHA AND {c.replace('FECHA', 't.FECHA').replace('month(h)', 'month(d.FECHA)').replace('h >=', 'd.FECHA >=').replace("', h)", "', d.FECHA)")}" for c in _TIERS], "NOT d.hol AND d.FECHA >= t.FECHA - INTERVAL 2 YEAR", "d.FECHA >= t.FECHA - INTERVAL 2 YEAR"]
_TIER_ROWS = " UNION ALL ".join([*[_FAR.format(tier=n + 1, cols=", ".join(f"d.{p}" for p in _SHOWN), cond=c) for n, c in enumerate(_OF_DAY)], _FAR.format(tier=7, cols=", ".join(f"d.tot / 24 AS {p}" for p in _SHOWN), cond="TRUE")])
_CURVE = f"""WITH t AS (SELECT t.UCP, t.FECHA, CASE WHEN {_CHRISTMAS.replace('FECHA', 't.FECHA')} THEN 'christmas' WHEN h.FECHA IS NOT NULL THEN 'holiday' ELSE 'normal' END AS route FROM ({_T}) t LEFT JOIN holidays h ON h.UCP = t.UCP AND h.FECHA = t.FECHA),
hist AS (SELECT d.UCP, d.FECHA, d.TOTAL AS tot, {' + '.join(HOURS)} AS s, {', '.join(_SHOWN)}, h.FECHA IS NOT NULL AS hol FROM demand_hours d LEFT JOIN holidays h ON h.UCP = d.UCP AND h.FECHA = d.FECHA),
same AS (SELECT UCP, FECHA, COUNT(*) AS same_n, AVG(tot) FILTER (WHERE n <= 2) AS total2, AVG(tot) FILTER (WHERE n <= 3) AS total3, {_SAME_AGG} FROM (SELECT t.UCP, t.FECHA, d.tot, d.s, {', '.join('d.' + p for p in _SHOWN)}, ROW_NUMBER() OVER (PARTITION BY t.UCP, t.FECHA ORDER BY d.FECHA DESC) AS n FROM t JOIN hist d ON d.UCP = t.UCP AND strftime(d.FECHA, '%m-%d') = strftime(t.FECHA, '%m-%d') AND d.FECHA < t.FECHA) WHERE n <= 5 GROUP BY 1, 2),
recent AS (SELECT t.UCP, t.FECHA, AVG(d.tot) FILTER (WHERE isodow(d.FECHA) = isodow(t.FECHA)) AS recent_dow, AVG(d.tot) AS recent_all FROM t JOIN hist d ON d.UCP = t.UCP AND NOT d.hol AND d.FECHA < t.FECHA AND d.FECHA >= t.FECHA - 60 GROUP BY 1, 2),
tiers AS (SELECT UCP, FECHA, tier, {', '.join(f'AVG({p}) AS tier_{p}' for p in _SHOWN)} FROM ({_TIER_ROWS}) GROUP BY 1, 2, 3 QUALIFY ROW_NUMBER() OVER (PARTITION BY UCP, FECHA ORDER BY tier) = 1),
months AS (SELECT UCP, month(FECHA) AS m, AVG(tot) AS hol_total, {', '.join(f'AVG({p} / s) AS hol_{p}' for p in _SHOWN)} FROM hist WHERE hol GROUP BY 1, 2),
overall AS (SELECT UCP, AVG(tot) AS g_total FROM hist GROUP BY 1)
SELECT UCP, FECHA, route, {_case(lambda name, v: name)} AS source, {', '.join(f'{_case(lambda name, v: v.format(p=p))} AS {p}' for p in _SHOWN)}
FROM t LEFT JOIN same USING (UCP, FECHA) LEFT JOIN recent USING (UCP, FECHA) LEFT JOIN tiers USING (UCP, FECHA) JOIN overall USING (UCP) LEFT JOIN (SELECT UCP AS mu, * EXCLUDE (UCP) FROM months) ON mu = UCP AND m = month(FECHA)"""


@R.add("curve_base", "UCP, FECHA:s, route, source, P1:r, P12:r, P24:r", with_tables(_CURVE, "demand_hours", "holidays"))
def curve_base(spark, sf):
    d = X.demand_hours(spark, sf)
    return B.base_curves(d, "2000-11-20", "2001-01-20", X.holidays(d), KEYS)


@R.add("curve_base_profiles", "UCP, FECHA:s, route, source, P1:r, P12:r, P24:r")
def curve_base_profiles(spark, sf):
    """As curve_base, with the cluster and special profiles of a fitted model."""
    d, hol, model = _model(spark, sf)
    return B.base_curves(d, "2000-11-20", "2001-01-20", hol, KEYS, model)


_PAIR = "SELECT a.UCP, a.FECHA, {hours_a} AS v, {hours_b} AS r, a.TOTAL FROM demand_hours a JOIN demand_hours b ON b.UCP = a.UCP AND b.FECHA = a.FECHA - 7".format(hours_a="[" + ", ".join(f"a.{h}" for h in HOURS) + "]", hours_b="[" + ", ".join(f"b.{h}" for h in HOURS) + "]")


def _pair(spark, sf):
    d = X.demand_hours(spark, sf)
    asked = d.select("UCP", "FECHA", "TOTAL", hours_array().alias("hours"), F.date_sub("FECHA", 7).alias("fecha_referencia"))
    return B.reference_day(d, asked, KEYS).where("ref is not null")


@R.add("curve_deltas", "UCP, FECHA:s, periodo:i, delta:r, delta_pct:r, relation", with_tables(f"SELECT UCP, FECHA, k AS periodo, v - r AS delta, CASE WHEN r <> 0 THEN (v - r) * 100.0 / r END AS delta_pct, CASE WHEN ABS(v - r) < 1e-9 THEN 'igual' WHEN v > r THEN 'superior' ELSE 'inferior' END AS relation FROM (SELECT UCP, FECHA, UNNEST(range(1, 25)) AS k, UNNEST(v) AS v, UNNEST(r) AS r FROM ({_PAIR}))", "demand_hours"))
def curve_deltas(spark, sf):
    return B.hour_deltas(_pair(spark, sf), KEYS)


@R.add("curve_clamped", "UCP, FECHA:s, periodo:i, value:r", with_tables(f"SELECT UCP, FECHA, k AS periodo, c * CASE WHEN SUM(c) OVER (PARTITION BY UCP, FECHA) > 0 THEN TOTAL / SUM(c) OVER (PARTITION BY UCP, FECHA) ELSE 1 END AS value FROM (SELECT UCP, FECHA, k, TOTAL, CASE WHEN r = 0 THEN v ELSE GREATEST(LEAST(v, r * 1.05), r * 0.95) END AS c FROM (SELECT UCP, FECHA, TOTAL, UNNEST(range(1, 25)) AS k, UNNEST(v) AS v, UNNEST(r) AS r FROM ({_PAIR})))", "demand_hours"))
def curve_clamped(spark, sf):
    return _long(B.clamp_to_reference(_pair(spark, sf)), "UCP", "FECHA", array="adjusted")


@R.add("curve_choice", "UCP, FECHA:s, tipopronostico, periodo:i, value:r", with_tables(f"SELECT UCP, FECHA, CASE WHEN day(FECHA) % 2 = 0 THEN 'Modelo IA' ELSE 'Modelo Base' END AS tipopronostico, k AS periodo, CASE WHEN day(FECHA) % 2 = 0 THEN v ELSE r END AS value FROM (SELECT UCP, FECHA, UNNEST(range(1, 25)) AS k, UNNEST(v) AS v, UNNEST(r) AS r FROM ({_PAIR}))", "demand_hours"))
def curve_choice(spark, sf):
    p = _pair(spark, sf)
    asked = p.select("UCP", "FECHA", F.when(F.dayofmonth("FECHA") % 2 == 0, "Modelo IA").otherwise("Modelo Base").alias("tipopronostico"))
    return _long(B.choose_source(asked, p, p.select("UCP", "FECHA", F.col("ref").alias("curve")), KEYS), "UCP", "FECHA", "tipopronostico", array="hours")


# ---- models


@R.add("model_split", "UCP, FECHA:s, split", with_tables("SELECT UCP, FECHA, CASE WHEN rn <= FLOOR(n * 0.8) THEN 'train' ELSE 'validation' END AS split FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY FECHA) AS rn, COUNT(*) OVER (PARTITION BY UCP) AS n FROM demand)", "demand"))
def model_split(spark, sf):
    return ML.temporal_split(X.demand(spark, sf), KEYS)


@R.add("model_folds", "UCP, fold:i, role, rows:i, first_day:s, last_day:s", with_tables("SELECT UCP, fold, role, COUNT(*) AS rows, MIN(FECHA) AS first_day, MAX(FECHA) AS last_day FROM (SELECT *, CASE WHEN rn <= n - (4 - fold) * (n // 4) THEN 'train' WHEN rn <= n - (3 - fold) * (n // 4) THEN 'test' END AS role FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY FECHA) AS rn, COUNT(*) OVER (PARTITION BY UCP) AS n FROM demand) CROSS JOIN (SELECT UNNEST([1, 2, 3]) AS fold)) WHERE role IS NOT NULL GROUP BY 1, 2, 3", "demand"))
def model_folds(spark, sf):
    return ML.cv_folds(X.demand(spark, sf), KEYS).groupBy("UCP", "fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("FECHA").alias("first_day"), F.max("FECHA").alias("last_day"))


def _training(d, w, lag_free=True):
    """(rows with their split, feature names): features of all keys, lag-free by default."""
    d = C.clean_demand(d)
    f = E.build_features(d, w, KEYS, shift=1)
    names = E.feature_names(f, d.columns, lag_free=lag_free)
    return stored(ML.temporal_split(E.fill_zero(f, names), KEYS), "training"), names


@R.add("model_training", "model, split, n:i, mape:r, rmape:r, mae:r, r2:r")
def model_training(spark, sf):
    """Trees on lag-free features of all keys, measured on both parts of a temporal split."""
    s, names = _training(*_inputs(spark, sf))
    return ML.evaluate(ML.train(s.where("split = 'train'"), names), s, ["split"])


@R.add("model_fitted_importances", "model, feature, importance:r")
def model_fitted_importances(spark, sf):
    """The twenty most important features of each trained model."""
    s, names = _training(*_inputs(spark, sf))
    return M.top_importances(ML.importances(ML.train(s.where("split = 'train'"), names), s, names), 20, ["model"])


_NAIVE_FOLDS = "SELECT d.UCP, fold, real, pred FROM (SELECT *, CASE WHEN rn > n - (4 - fold) * (n // 4) AND rn <= n - (3 - fold) * (n // 4) THEN 1 END AS test FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY UCP ORDER BY FECHA) AS rn, COUNT(*) OVER (PARTITION BY UCP) AS n FROM naive) CROSS JOIN (SELECT UNNEST([1, 2, 3]) AS fold)) d WHERE test = 1"


@R.add("model_cv_naive", "model, mape_mean:r, mape_std:r", with_tables(f"SELECT 'lag7' AS model, AVG(mape) AS mape_mean, STDDEV_POP(mape) AS mape_std FROM (SELECT fold, AVG(ABS(pred - real) * 100.0 / ABS(real)) AS mape FROM ({_NAIVE_FOLDS}) WHERE ABS(real) > 1e-10 GROUP BY 1)", "naive"))
def model_cv_naive(spark, sf):
    """The folds and the summary of cross-validation with a model that needs no fit."""
    f = ML.cv_folds(X.naive_forecast(X.demand(spark, sf)), KEYS).where("role = 'test'")
    return ML.cv_summary(ML.fold_metrics(f.select(F.lit("lag7").alias("model"), "fold", "real", F.col("pred").alias("demanda_predicha")), "real"))


@R.add("model_cross_validation", "model, mape_mean:r, mape_std:r, rmape_mean:r, rmape_std:r")
def model_cross_validation(spark, sf):
    """All trained models over three expanding folds."""
    s, names = _training(*_inputs(spark, sf))
    return ML.cross_validate(s.drop("split"), names, KEYS)


def _champions(spark, sf):
    """Models and champions of each key, written to a store and read back; and what they were made of, demand and weather."""
    d, w = _inputs(spark, sf)
    s, names = _training(d, w)
    served = _serving(d, w, 1).columns
    models = ML.train(s.where("split = 'train'"), [c for c in names if c in served])
    path = f"{scratch(spark)}/models-{uuid.uuid4().hex}"
    ML.save_models(models, ML.champions(models, s.where("split = 'validation'"), KEYS), path)
    return ML.load_models(spark, path), (d, w)


@R.add("model_champion_trained", "UCP, model, n:i, rmape:r, mape:r, mae:r")
def model_champion_trained(spark, sf):
    """The trained model that does best on each key's validation rows, as the model store has it."""
    return _champions(spark, sf)[0][1]


@R.add("forecast_champion", "UCP, FECHA:s, model, demanda_predicha:r, adjusted:b")
def forecast_champion(spark, sf):
    """Thirty days of every key, each by its own champion out of the model store."""
    (models, best), inputs = _champions(spark, sf)
    used = next(iter(models.values())).stages[0].getInputCols()
    return F_.forecast_direct(_serving(*inputs).fillna(0, used), lambda f: ML.score_with_champions(models, best, f, KEYS, default="forest"))
