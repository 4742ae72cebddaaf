"""Running values by key and block against plain windows and plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattloom.operators import blocked as B
from wattloom.operators import features as E
from wattloom.operators import forecast as FC

K = ["UCP"]
SCHEMA = "UCP string, FECHA date, TOTAL double, other double, `__v` string"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def series(spark):
    """One key with most rows, one with a few, one without a value; half the values are null."""
    r = random.Random(3)
    rows = [(k, day(n), r.choice([None, float(r.randint(0, 9))]), r.choice([None, 1.5]), "x") for k, days in (("hot", 900), ("small", 40), ("void", 70)) for n in r.sample(range(1200), days)]
    rows = [(k, d, None if k == "void" else v, o, x) for k, d, v, o, x in rows]
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    key = lambda r: str(r)
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    assert sorted(map(key, a.select(cols).collect())) == sorted(map(key, b.select(cols).collect()))


def test_equal_to_windows_by_key(series):
    same(B.fill_forward(series, K, ["TOTAL", "other"]), E.fill_forward(series, K, ["TOTAL", "other"]))
    same(B.day_change(series, K), E.day_change(series, K))


@pytest.mark.parametrize("block", [None, "1", "datediff(FECHA, '2000-01-01')"])
def test_any_blocks_give_the_same(series, block):
    same(B.fill_forward(series, K, ["TOTAL"], block=block and F.expr(block)), E.fill_forward(series, K, ["TOTAL"]))


def test_as_of(spark, series):
    t = spark.createDataFrame([(k, day(n), n) for k in ("hot", "small", "void", "unknown") for n in range(-40, 1300, 7)], "UCP string, at date, n int")
    history = series.drop("__v")
    same(B.as_of(t, history, K, "at", ["TOTAL", "other"]), FC.as_of(t, history, K, "at", ["TOTAL", "other"]))


def test_sums_run_over_blocks(series):
    got = B.running(series, K, "FECHA", {"so_far": F.col("TOTAL")}, F.sum).collect()
    for r in got:
        own = [x["TOTAL"] for x in got if x["UCP"] == r["UCP"] and x["FECHA"] <= r["FECHA"] and x["TOTAL"] is not None]
        assert r["so_far"] == (sum(own) if own else None)


def test_no_task_holds_a_key(series):
    """Rows go to tasks by key and block: with enough partitions the large key's 900 rows lie in many."""
    old = series.sparkSession.conf.get("spark.sql.shuffle.partitions"), series.sparkSession.conf.get("spark.sql.adaptive.enabled")
    series.sparkSession.conf.set("spark.sql.shuffle.partitions", "32")
    series.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = [r["count"] for r in B.fill_forward(series, K, ["TOTAL"]).where("UCP = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.sum("TOTAL")).collect()]
    finally:
        series.sparkSession.conf.set("spark.sql.shuffle.partitions", old[0])
        series.sparkSession.conf.set("spark.sql.adaptive.enabled", old[1])
    assert sum(parts) == 900 and len(parts) >= 16 and max(parts) < 200


def test_edge_rows(spark):
    d = dt.date(2020, 5, 4)
    rows = [(None, d, 3.0), (None, day(400), None), ("a", None, 7.0), ("a", None, None), ("a", d, None), ("b", d, 2.0), ("b", d, 5.0), ("b", d, None), ("b", day(300), None)]
    df = spark.createDataFrame(rows, "UCP string, FECHA date, TOTAL double")
    got = sorted(map(str, [tuple(r) for r in B.fill_forward(df, K, ["TOTAL"]).collect()]))
    # a null key is a key; a null date passes nothing on; of a date that repeats the largest value is the last
    want = [(None, d, 3.0), (None, day(400), 3.0), ("a", None, 7.0), ("a", None, 0.0), ("a", d, 0.0), ("b", d, 2.0), ("b", d, 5.0), ("b", d, 5.0), ("b", day(300), 5.0)]
    assert got == sorted(map(str, want))
    none = df.limit(0)
    assert B.fill_forward(none, K, ["TOTAL"]).count() == 0 and B.day_change(none, K).count() == 0
    t = spark.createDataFrame([("b", d), ("b", None), ("zz", d)], "UCP string, at date")
    assert {tuple(r) for r in B.as_of(t, df, K, "at", ["TOTAL"]).select("UCP", "at", "TOTAL").collect()} == {("b", d, 5.0), ("b", None, 5.0), ("zz", d, 0.0)}
    assert [r["TOTAL"] for r in B.as_of(t, none, K, "at", ["TOTAL"]).collect()] == [0.0] * 3
