"""Readers and writers of the demand-series tables."""

from __future__ import annotations

from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions.calendar import weekday_name
from wattloom.functions.expressions import row_sum, to_date, to_double
from wattloom.schema import DEMAND_COLUMNS, DEMAND_FEED, DEMAND_TEXT, HOLIDAY_FILE, HOURS, KEYS, WEATHER_FEED, WEATHER_HOURLY, WEATHER_TEXT
from wattloom.session import stored

#: The folder column of a table that grows by increments.
MONTH = "landed_month"


def date_range(df: DataFrame, date: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from start to end, both included; either may be open."""
    if start:
        df = df.where(F.col(date) >= F.to_date(F.lit(start)))
    if end:
        df = df.where(F.col(date) <= F.to_date(F.lit(end)))
    return df


def read_demand_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily demand: dates that don't parse and numbers that don't are null; a date range drops null dates."""
    raw = spark.read.schema(DEMAND_TEXT).option("header", True).option("enforceSchema", False).csv(path)
    typed = raw.select(*[to_date(c).alias(c) if c == "FECHA" else to_double(c).alias(c) if c in (*HOURS, "TOTAL") else F.col(c) for c in DEMAND_COLUMNS])
    return date_range(typed, "FECHA", start, end)


def read_by_header(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """CSV files as they come, whose columns may differ in number and order: (rows, broken).

    rows has every column that any file has, as text, null where a file lacks it, and source_file; broken has (source_file,
    line, reason) for lines with more or fewer fields than their file's header ("fields") and for all lines of a file without
    a header ("header").  A header is a line that names all of `required`; it must be the file's first, and one that comes
    again is a row like any other.  Empty lines are passed over; a quoted field must not hold a line break.  No files, or
    empty ones, give no rows and the required columns.  A file's columns named source_file or _broken aren't kept.

    Files are told apart by header: one scan for each distinct header, whose names and files are what the driver holds; a
    line is parsed once, and never shuffled."""
    lines = spark.read.text(path).where("value != ''").select("value", F.col("_metadata.file_path").alias("source_file"))
    names = F.transform(F.split("value", ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    heads = lines.select("source_file", names.alias("names")).where(F.forall(F.array(*[F.lit(c) for c in required]), lambda c: F.array_contains("names", c)))
    known = heads.groupBy("source_file").agg(F.min("names").alias("names"))
    layouts = known.groupBy("names").agg(F.collect_list("source_file").alias("files")).orderBy("names").collect()
    text = ", ".join(f"`{c}` string" for c in required)
    rows = spark.createDataFrame([], f"{text}, source_file string")
    none = lines.join(known, "source_file", "left_anti")
    broken = none.select("source_file", F.col("value").alias("line"), F.lit("header").alias("reason"))
    for layout in layouts:
        schema = ", ".join(f"`{c}` string" for c in [*layout["names"], "_broken"])
        read = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_broken").option("columnPruning", False)
        d = read.csv([unquote(f) for f in layout["files"]]).select("*", F.col("_metadata.file_path").alias("source_file"))
        # Spark refuses a scan of the broken line alone, so a part of no length of the first field goes with it
        line = F.concat_ws("", "_broken", F.substring(F.col(f"`{layout['names'][0]}`"), 1, 0))
        rows = rows.unionByName(d.where(line == "").drop("_broken"), allowMissingColumns=True)
        broken = broken.unionByName(d.where(line != "").select("source_file", line.alias("line"), F.lit("fields").alias("reason")))
    return rows, broken


def file_alerts(rows: DataFrame, broken: DataFrame, expected: list[str]) -> DataFrame:
    """(source_file, check, level, n): broken lines of each file, lines of files without a header, and the expected columns
    that a file with rows never fills; with level and check as alert_rollup takes them."""
    bad = broken.groupBy("source_file", F.concat(F.lit("broken_"), "reason").alias("check")).agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit("ALERT"))
    filled = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), *[(F.count(c) if c in rows.columns else F.lit(0).cast("bigint")).alias(f"__{i}") for i, c in enumerate(expected)])
    gone = F.array_compact(F.array(*[F.when(F.col(f"__{i}") == 0, F.lit(c)) for i, c in enumerate(expected)]))
    lacks = filled.select("source_file", F.explode(gone).alias("c"), "n").select("source_file", F.concat(F.lit("column_"), "c").alias("check"), "n", F.lit("WARNING").alias("level"))
    return bad.unionByName(lacks).select("source_file", "check", "level", "n")


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def read_weather_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hourly weather; the range applies before any aggregation; rows without a date go."""
    raw = spark.read.schema(WEATHER_TEXT).option("header", True).csv(path)
    return check_weather(raw, start, end)


def check_weather(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if gone := missing_columns(df, WEATHER_HOURLY):
        raise ValueError(f"weather columns missing: {gone}")
    typed = df.withColumns({"fecha": to_date("fecha"), "periodo": F.col("periodo").try_cast("int"), **{c: to_double(c) for c in ("p_t", "p_h", "p_v", "p_i")}})
    return date_range(typed.where(F.col("fecha").isNotNull()), "fecha", start, end)


def latest(df: DataFrame, days_back: int, asof: Column, date: str = "FECHA") -> DataFrame:
    """The days_back days up to asof, both ends included."""
    return df.where(F.col(date).between(F.date_sub(asof, days_back), asof))


def demand_from_feed(feed: DataFrame, ucp: str | Column, variable: str = "Demanda_Real", clasificador: str = "NORMAL") -> DataFrame:
    """Feed rows (data: array of fecha, p1..p24) as daily demand rows; TOTAL sums the hours, nulls as 0.  ucp is the unit, or
    a column of the feed that names it, so that the feeds of all units are read in one pass."""
    unit = ucp if isinstance(ucp, Column) else F.lit(ucp)
    d = feed.select(unit.alias("UCP"), F.explode("data").alias("r")).select("UCP", to_date("r.fecha").alias("FECHA"), *[F.col(f"r.p{h}").alias(f"P{h}") for h in range(1, 25)])
    return d.select("UCP", F.lit(variable).alias("VARIABLE"), "FECHA", F.lit(clasificador).alias("Clasificador interno"), weekday_name("FECHA").alias("TIPO DIA"), *HOURS, row_sum(HOURS).alias("TOTAL"))


def read_demand_feed(spark: SparkSession, path: str, ucp: str, **literals: str) -> DataFrame:
    return demand_from_feed(spark.read.schema(DEMAND_FEED).option("multiLine", True).json(path), ucp, **literals)


def weather_from_feed(feed: DataFrame, ucp: Column | None = None) -> DataFrame:
    """Feed rows (fecha, p{1..24}_{t,h,v,i}) as hourly rows, by one explode of 24 structs; with ucp, a column of the feed
    that names the unit, the feeds of all units in one pass, the unit first."""
    own = [] if ucp is None else [ucp.alias("UCP")]
    d = feed.select(*own, F.explode("data").alias("r"))
    each = [F.struct(F.lit(h).alias("periodo"), *[F.col(f"r.p{h}_{v}").alias(f"p_{v}") for v in "thvi"]) for h in range(1, 25)]
    return d.select(*(["UCP"] if own else []), to_date("r.fecha").alias("fecha"), F.explode(F.array(*each)).alias("x")).select(*(["UCP"] if own else []), "fecha", "x.*")


def read_weather_feed(spark: SparkSession, path: str) -> DataFrame:
    return weather_from_feed(spark.read.schema(WEATHER_FEED).option("multiLine", True).json(path))


def holidays_from_file(calendar: DataFrame, ucp: str = "*") -> DataFrame:
    """(UCP, FECHA, nombre) from rows (festivos: array, descripcion_festivos: map)."""
    d = calendar.select(F.explode("festivos").alias("f"), "descripcion_festivos")
    return d.select(F.lit(ucp).alias("UCP"), to_date("f").alias("FECHA"), F.try_element_at("descripcion_festivos", F.col("f")).alias("nombre"))


def read_holidays(spark: SparkSession, path: str, ucp: str = "*", start: str | None = None, end: str | None = None) -> DataFrame:
    return date_range(holidays_from_file(spark.read.schema(HOLIDAY_FILE).option("multiLine", True).json(path), ucp), "FECHA", start, end)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", keys: list[str] | None = None) -> None:
    """Overwrites a cleaned or feature table, one folder for each key."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.partitionBy(*(KEYS if keys is None else keys)).save(path) if keys != [] else w.save(path)


def land_increment(new: DataFrame, path: str, keys: list[str], date: str = "FECHA", replace: bool = False) -> DataFrame:
    """Adds an increment to the table at path, one folder a month (landed_month=yyyy-MM), and rewrites only months that gain
    or change a row.  Returns (landed_month, added, changed), a row for each month written.

    A row is known by its keys and date; null keys equal one another, and null dates have a folder of their own.  A row that is
    there already stays, or with `replace` gives way to a new one that differs in any column; rows that repeat within the
    increment count once (the least by all columns, nulls first).  The same increment again so writes nothing, and files of
    other months keep their names.  A column that one side lacks is null there; types must agree, and a column named
    landed_month isn't kept.  An empty increment writes nothing, and leaves no table where there was none.

    Only the increment's months are read; their names are all that the driver holds.  Rows to write are stored beside the table
    first and then replace their months in one commit (dynamic partition overwrite), so a failed job leaves the table as it
    was; a rebalance splits a month with many rows.  Two increments must not land at the same time."""
    spark = new.sparkSession
    cols = [c for c in new.columns if c != MONTH]
    one = new.select(F.struct(*cols).alias("__r")).groupBy(*[F.col(f"__r.`{c}`").alias(f"__k{i}") for i, c in enumerate([*keys, date])]).agg(F.min("__r").alias("__r"))
    inc = stored(one.select("__r.*").withColumn(MONTH, F.date_format(date, "yyyy-MM")), "increment")
    months = [r[0] for r in inc.select(MONTH).distinct().collect()]
    old = table_by_month(spark, path)
    old = inc.limit(0) if old is None else old.where(F.col(MONTH).isin([m for m in months if m is not None]) | (F.col(MONTH).isNull() & F.lit(None in months)))
    every = [*[c for c in old.columns if c != MONTH], *[c for c in cols if c not in old.columns], MONTH]
    row = lambda d, other: F.struct(*[F.col(f"`{c}`") if c in d.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in every])
    have, come = old.select(row(old, inc).alias("__h")), inc.select(row(inc, old).alias("__i"))
    pair = reduce(and_, [F.col(f"__h.`{c}`").eqNullSafe(F.col(f"__i.`{c}`")) for c in [*keys, date]])
    added = F.col("__h").isNull()
    changed = F.col("__h").isNotNull() & F.col("__i").isNotNull() & ~F.col("__h").eqNullSafe(F.col("__i")) if replace else F.lit(False)
    j = have.join(come, pair, "full").select(F.when(added | changed, F.col("__i")).otherwise(F.col("__h")).alias("__r"), added.alias("__new"), changed.alias("__changed"))
    both = stored(j, "merged")
    touched = stored(both.groupBy(F.col(f"__r.{MONTH}").alias(MONTH)).agg(F.count_if("__new").alias("added"), F.count_if("__changed").alias("changed")).where("added + changed > 0"), "landed")
    rows = both.select("__r").join(touched.select(F.col(MONTH).alias("__m")), F.col(f"__r.{MONTH}").eqNullSafe(F.col("__m")), "left_semi").select("__r.*")
    rows.hint("rebalance", F.col(MONTH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    spark.catalog.refreshByPath(path)
    return touched


def table_by_month(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that land_increment keeps, with its month as text; None where there is none yet.  A column that came with a
    later increment is null in months that have not been written since."""
    try:
        found = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found.withColumn(MONTH, F.col(MONTH).cast("string"))


def write_forecast(forecast: DataFrame, summary: DataFrame, path: str) -> None:
    """The forecast as CSV and its one-row summary for each key as JSON."""
    forecast.write.mode("overwrite").option("header", True).csv(f"{path}/forecast")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_results(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
