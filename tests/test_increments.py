"""Increments that land by month: what is written, what stays, and edge rows."""

import datetime
import os

from wattloom.sources.files import land_increment, table_by_month

D = datetime.date
SCHEMA = "UCP string, FECHA date, TOTAL double, added string"


def files(path):
    return {(folder[len(path):], f) for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(spark, path, *cols):
    return sorted((tuple(r[c] for c in cols) for r in table_by_month(spark, path).collect()), key=repr)


def log(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_only_touched_months_are_written(spark, tmp_path):
    p = f"{tmp_path}/t"
    make = lambda *r: spark.createDataFrame([(*x, "x") for x in r], SCHEMA)
    first = make(("a", D(2020, 1, 5), 1.0), ("a", D(2020, 2, 5), 2.0), ("b", D(2020, 2, 6), 3.0), ("b", D(2020, 2, 6), 3.5))
    assert log(land_increment(first, p, ["UCP"])) == [("2020-01", 1, 0), ("2020-02", 2, 0)]
    before = files(p)
    assert log(land_increment(first, p, ["UCP"])) == [] and files(p) == before
    second = make(("a", D(2020, 2, 5), 9.0), ("a", D(2020, 3, 1), 4.0))
    assert log(land_increment(second, p, ["UCP"])) == [("2020-03", 1, 0)] and before <= files(p)
    assert rows(spark, p, "UCP", "FECHA", "TOTAL") == [("a", D(2020, 1, 5), 1.0), ("a", D(2020, 2, 5), 2.0), ("a", D(2020, 3, 1), 4.0), ("b", D(2020, 2, 6), 3.0)]
    held = {x for x in files(p) if "2020-02" not in x[0]}
    assert log(land_increment(second, p, ["UCP"], replace=True)) == [("2020-02", 0, 1)]
    assert held <= files(p) and not {x for x in before if "2020-02" in x[0]} & files(p)
    assert rows(spark, p, "UCP", "FECHA", "TOTAL")[1] == ("a", D(2020, 2, 5), 9.0) and len(rows(spark, p, "UCP")) == 4


def test_nulls_empty_increments_and_new_columns(spark, tmp_path):
    p = f"{tmp_path}/t"
    none = spark.createDataFrame([], SCHEMA)
    assert log(land_increment(none, p, ["UCP"])) == [] and table_by_month(spark, p) is None
    odd = spark.createDataFrame([(None, D(2020, 1, 1), None, "x"), ("a", None, 1.0, None), (None, None, 2.0, "y")], SCHEMA)
    assert log(land_increment(odd, p, ["UCP"])) == [("2020-01", 1, 0), (None, 2, 0)]
    assert log(land_increment(odd, p, ["UCP"], replace=True)) == [] and log(land_increment(none, p, ["UCP"])) == []
    wider = spark.createDataFrame([("b", D(2020, 1, 2), 5.0, 7, "clash")], "UCP string, FECHA date, TOTAL double, `__r` int, landed_month string")
    assert log(land_increment(wider, p, ["UCP"])) == [("2020-01", 1, 0)]
    assert rows(spark, p, "UCP", "TOTAL", "added", "__r", "landed_month") == sorted([("a", 1.0, None, None, None), ("b", 5.0, None, 7, "2020-01"), (None, 2.0, "y", None, None), (None, None, "x", None, "2020-01")], key=repr)
