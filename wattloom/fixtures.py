"""Demand-series tables made from the star-schema test tables, in Spark and as SQL, for the registered queries.

Daily demand is the value of orders by region and day; hours spread it by a weight that depends on hour,
weekday and day; a second hourly table (with gaps) comes from events; weather from line items; holidays are
fixed month-days in every year that the data has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.functions.calendar import weekday_name
from wattloom.schema import HOURS

KEYS = ["UCP"]
#: Holidays by month-day, and the years that get them.
HOLIDAY_MMDD = ["01-01", "05-01", "07-20", "08-07", "12-08", "12-25"]
FIRST_YEAR, LAST_YEAR = 1994, 2025


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(UCP, FECHA, TOTAL).  Orders are summed by customer and day before the small dimensions are joined."""
    o = read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("FECHA"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("UCP"))
    where = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "UCP")
    return o.join(where, F.col("o_custkey") == F.col("c_custkey")).groupBy("UCP", "FECHA").agg(F.sum("v").cast("double").alias("TOTAL"))


def demand_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(UCP, VARIABLE, FECHA, Clasificador interno, TIPO DIA, P1..P24, TOTAL)."""
    d = demand(spark, sf_dir).withColumn("a", F.weekday("FECHA") * 3 + F.dayofmonth("FECHA"))
    # the 24 weights add up to w: their remainders repeat every seven hours
    d = d.withColumn("w", F.lit(433.0) + (F.col("a") + 1) % 7 + (F.col("a") + 2) % 7 + (F.col("a") + 3) % 7)
    # rows by hour, then a pivot, as a feed would bring them
    hours = d.select("UCP", "FECHA", "TOTAL", "a", "w", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("h"))
    hours = hours.withColumn("v", F.col("TOTAL") * (F.lit(10) + F.col("h") * (25 - F.col("h")) / F.lit(20.0) + (F.col("a") + F.col("h")) % 7) / F.col("w"))
    p = hours.groupBy("UCP", "FECHA").agg(F.max("TOTAL").alias("TOTAL"), *[F.max(F.when(F.col("h") == h, F.col("v"))).alias(f"P{h}") for h in range(1, 25)])
    return p.select("UCP", F.lit("Demanda_Real").alias("VARIABLE"), "FECHA", F.lit("NORMAL").alias("Clasificador interno"), weekday_name("FECHA").alias("TIPO DIA"), *HOURS, "TOTAL")


def load_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(UCP, FECHA, P1..P24, TOTAL) from line items: whole numbers, and every day has a curve of its own."""
    r = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("UCP"))
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("FECHA"), (F.col("l_partkey") % 24 + 1).alias("h"), F.col("l_quantity").cast("bigint").alias("v"))
    sums = li.groupBy("l_suppkey", "FECHA", "h").agg(F.sum("v").alias("v")).join(r, F.col("l_suppkey") % 5 == F.col("r_regionkey"))
    p = sums.groupBy("UCP", "FECHA").agg(*[(F.coalesce(F.sum(F.when(F.col("h") == h, F.col("v"))), F.lit(0)) + 200 + h * (25 - h)).cast("double").alias(f"P{h}") for h in range(1, 25)], (F.sum("v") + sum(200 + h * (25 - h) for h in range(1, 25))).cast("double").alias("TOTAL"))
    return p.select("UCP", "FECHA", *HOURS, "TOTAL")


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(UCP, VARIABLE, FECHA, Clasificador interno, TIPO DIA, P1..P24 with gaps, TOTAL)."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("UCP"), F.to_date("ts").alias("FECHA"), (F.hour("ts") + 1).alias("h"), F.col("value").cast("decimal(18,6)").alias("v"))
    p = e.groupBy("UCP", "FECHA").agg(*[F.sum(F.when(F.col("h") == h, F.col("v"))).cast("double").alias(f"P{h}") for h in range(1, 25)], F.sum("v").cast("double").alias("TOTAL"))
    return p.select("UCP", F.lit("Demanda_Real").alias("VARIABLE"), "FECHA", F.lit("NORMAL").alias("Clasificador interno"), weekday_name("FECHA").alias("TIPO DIA"), *HOURS, "TOTAL")


def weather_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(UCP, fecha, periodo, p_t, p_h, p_v, p_i), a reading for each line item."""
    r = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("UCP"))
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("fecha"), F.col("l_linenumber").alias("periodo"), F.col("l_quantity").alias("p_t"), (F.col("l_discount") * 1000).alias("p_h"), (F.col("l_tax") * 100).alias("p_v"), (F.col("l_extendedprice") / 1000).alias("p_i"))
    return li.join(r, F.col("l_suppkey") % 5 == F.col("r_regionkey")).select("UCP", "fecha", "periodo", "p_t", "p_h", "p_v", "p_i")


def holidays(df: DataFrame) -> DataFrame:
    """(UCP, FECHA, nombre) for the keys of df."""
    days = F.array(*[F.to_date(F.lit(f"{y}-{m}")) for y in range(FIRST_YEAR, LAST_YEAR + 1) for m in HOLIDAY_MMDD])
    return df.select("UCP").distinct().select("UCP", F.explode(days).alias("FECHA"), F.lit(None).cast("string").alias("nombre"))


def naive_forecast(d: DataFrame) -> DataFrame:
    """(UCP, FECHA, real, pred): the value seven rows before as the prediction."""
    w = Window.partitionBy("UCP").orderBy("FECHA")
    return d.select("UCP", "FECHA", F.col("TOTAL").alias("real"), F.lag("TOTAL", 7).over(w).alias("pred")).where("pred is not null")


_W = lambda h: f"({10 + h * (25 - h) / 20.0} + ((isodow(FECHA) - 1) * 3 + day(FECHA) + {h}) % 7)"
_DAY = "list_extract(['LUNES','MARTES','MIÉRCOLES','JUEVES','VIERNES','SÁBADO','DOMINGO'], CAST(isodow(FECHA) AS INT))"
SQL = {
    "demand": "SELECT r_name AS UCP, CAST(o_orderdate AS DATE) AS FECHA, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS TOTAL FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "demand_hours": f"SELECT UCP, 'Demanda_Real' AS VARIABLE, FECHA, 'NORMAL' AS \"Clasificador interno\", {_DAY} AS \"TIPO DIA\", {', '.join(f'TOTAL * {_W(h)} / ({" + ".join(_W(k) for k in range(1, 25))}) AS P{h}' for h in range(1, 25))}, TOTAL FROM demand",
    "load_hours": f"SELECT r_name AS UCP, CAST(l_shipdate AS DATE) AS FECHA, {', '.join(f'CAST(COALESCE(SUM(CASE WHEN l_partkey % 24 + 1 = {h} THEN CAST(l_quantity AS BIGINT) END), 0) + {200 + h * (25 - h)} AS DOUBLE) AS P{h}' for h in range(1, 25))}, CAST(SUM(CAST(l_quantity AS BIGINT)) + {sum(200 + h * (25 - h) for h in range(1, 25))} AS DOUBLE) AS TOTAL FROM lineitem JOIN region ON l_suppkey % 5 = r_regionkey GROUP BY 1, 2",
    "event_hours": f"SELECT UCP, 'Demanda_Real' AS VARIABLE, FECHA, 'NORMAL' AS \"Clasificador interno\", {_DAY} AS \"TIPO DIA\", {', '.join(f'CAST(SUM(CASE WHEN h = {h} THEN v END) AS DOUBLE) AS P{h}' for h in range(1, 25))}, CAST(SUM(v) AS DOUBLE) AS TOTAL FROM (SELECT event_type AS UCP, CAST(ts AS DATE) AS FECHA, hour(ts) + 1 AS h, CAST(value AS DECIMAL(18,6)) AS v FROM events) GROUP BY UCP, FECHA",
    "weather_hours": "SELECT r_name AS UCP, CAST(l_shipdate AS DATE) AS fecha, l_linenumber AS periodo, l_quantity AS p_t, l_discount * 1000 AS p_h, l_tax * 100 AS p_v, l_extendedprice / 1000 AS p_i FROM lineitem JOIN region ON l_suppkey % 5 = r_regionkey",
    "weather": "SELECT UCP, fecha AS FECHA, AVG(p_t) AS temp_mean, MIN(p_t) AS temp_min, MAX(p_t) AS temp_max, COALESCE(STDDEV_SAMP(p_t), 2.5) AS temp_std, AVG(p_h) AS humidity_mean, MIN(p_h) AS humidity_min, MAX(p_h) AS humidity_max, AVG(p_v) AS wind_speed_mean, MAX(p_v) AS wind_speed_max, AVG(p_i) AS rain_mean, SUM(p_i) AS rain_sum FROM weather_hours GROUP BY 1, 2",
    "holidays": f"SELECT r_name AS UCP, CAST(y || '-' || m AS DATE) AS FECHA FROM region, (SELECT UNNEST(range({FIRST_YEAR}, {LAST_YEAR + 1})) AS y), (SELECT UNNEST([{', '.join(repr(m) for m in HOLIDAY_MMDD)}]) AS m)",
    "naive": "SELECT * FROM (SELECT UCP, FECHA, TOTAL AS real, LAG(TOTAL, 7) OVER (PARTITION BY UCP ORDER BY FECHA) AS pred FROM demand) WHERE pred IS NOT NULL",
    "errors": "SELECT *, pred - real AS error, ABS(pred - real) AS abs_error, CASE WHEN real <> 0 THEN (pred - real) * 100.0 / real END AS error_pct, CASE WHEN real <> 0 THEN ABS((pred - real) * 100.0 / real) END AS abs_error_pct FROM naive",
}
_NEEDS = {"demand_hours": ["demand"], "weather": ["weather_hours"], "naive": ["demand"], "errors": ["demand", "naive"]}


def with_tables(sql: str, *names: str) -> str:
    """The SQL with the named fixture tables (and those that they need) before it."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return f"WITH {', '.join(f'{n} AS ({SQL[n]})' for n in order)}{', ' + sql[5:] if sql.startswith('WITH ') else ' ' + sql}"


def recursive_with_tables(sql: str, *names: str) -> str:
    """with_tables for SQL that starts with WITH RECURSIVE."""
    return with_tables(sql.replace("WITH RECURSIVE ", "WITH ", 1), *names).replace("WITH ", "WITH RECURSIVE ", 1)
