"""Exact quantiles in two passes against `percentile`: a hot group, ties, nulls, edge groups."""

import math

import pytest
from pyspark.sql import functions as F

from wattloom.operators.quantiles import exact_quantiles

PROBS = {"least": 0.0, "a": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "b": 0.999, "most": 1.0}


def compare(df, by, accuracy):
    got = {tuple(r[b] for b in by): r for r in exact_quantiles(df, "v", by, PROBS, accuracy).collect()}
    v = F.when(~F.isnan("v"), F.col("v"))
    want = {tuple(r[b] for b in by): r for r in df.groupBy(*by).agg(F.count(v).alias("n"), *[F.percentile(v, F.lit(p)).alias(c) for c, p in PROBS.items()]).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k]["n"] == w["n"], k
        for c in PROBS:
            assert (got[k][c] is None and w[c] is None) or got[k][c] == pytest.approx(w[c], rel=1e-12), (k, c)


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_equal_to_percentile(spark, accuracy):
    """A third of the rows in one group, one value in half of another, skewed values, single rows, nulls and NaN; columns
    named like the operator's own."""
    i = F.col("id")
    g = F.when(i % 3 == 0, "hot").when(i % 3 == 1, F.concat(F.lit("g"), i % 7)).when(i < 100, F.concat(F.lit("one"), i)).when(i % 5 == 0, None).otherwise("ties")
    u = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")
    v = F.when(i % 97 == 0, None).when(i % 89 == 0, float("nan")).when(g == "ties", F.when(i % 2 == 0, 7.0).otherwise(F.floor(u / 1e5))).when(g == "hot", F.exp(u / 1e5)).otherwise(u)
    d = spark.range(0, 30000, 1, 6).select(g.alias("k"), v.alias("v"), F.lit(1).alias("n"), F.lit(2).alias("__p"))
    none = spark.range(3).select(F.lit("none").alias("k"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("n"), F.lit(2).alias("__p"))
    compare(d.unionByName(none), ["k"], accuracy)


def test_without_groups_and_without_rows(spark):
    d = spark.createDataFrame([(float(x * x % 101),) for x in range(500)] + [(math.inf,)], "v double")
    compare(d, [], 100)
    (r,) = exact_quantiles(d.where("false"), "v", [], PROBS).collect()
    assert r["n"] == 0 and r["q50"] is None
    assert exact_quantiles(d.where("false").withColumn("k", F.lit(1)), "v", ["k"], PROBS).count() == 0
