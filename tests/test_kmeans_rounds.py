"""k-means as rounds over all keys, against a plain loop, on edge rows, and against the seeded fit."""

import datetime
import random

import numpy as np
import pytest

from wattloom.operators import profiles as H

SCHEMA = "UCP string, FECHA date, profile array<double>, cluster string, __note int"
DAY = datetime.date(2020, 1, 1)


def plain(days, clusters, starts, rounds=50):
    """{date: cluster} of one key."""
    days = sorted(days)
    x, n = np.array([p for _, p in days]), len(days)
    k, best = min(clusters, n), None
    near = lambda c: [min(range(k), key=lambda j: (float(((v - c[j]) ** 2).sum()), j)) for v in x]
    for s in range(starts):
        c = x[[((2 * starts * j + 2 * s + 1) * n) // (2 * starts * k) for j in range(k)]]
        for _ in range(rounds):
            at = near(c)
            new = np.array([x[[a == j for a in at]].mean(0) if j in at else c[j] for j in range(k)])
            still, c = np.abs(new - c).max() <= 1e-9, new
            if still:
                break
        at = near(c)
        cost = round(float(sum(((v - c[a]) ** 2).sum() for v, a in zip(x, at))), 12)
        if best is None or cost < best[0]:
            best = (cost, at)
    number = {}
    return {d: number.setdefault(a, len(number)) for (d, _), a in zip(days, best[1])}


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(5)
    days = {}
    for key, n in (("a", 60), ("b", 7), ("c", 1), ("same", 9)):
        kinds = [[rnd.random() for _ in range(24)] for _ in range(5)]
        base = [[v + rnd.random() * 0.4 for v in rnd.choice(kinds)] for _ in range(n)]
        days[key] = [(DAY + datetime.timedelta(3 * i), [1 / 24] * 24 if key == "same" else p) for i, p in enumerate(base)]
    return days


@pytest.mark.parametrize("clusters,starts", [(6, 3), (20, 1)])
def test_rounds_equal_a_plain_loop(spark, data, clusters, starts):
    """Keys of many, few and one day, equal days, a repeated date, null profile and null key; columns named like its own."""
    rows = [(k, d, p, "x", 1) for k, v in data.items() for d, p in v]
    rows += [rows[0], ("a", DAY + datetime.timedelta(1), None, "x", 1), (None, DAY, [0.5] * 24, "x", 1)]
    got = H.lloyd_clusters(spark.createDataFrame(rows, SCHEMA), ["UCP"], clusters, starts).collect()
    assert len(got) == sum(len(v) for v in data.values()) and set(got[0].asDict()) == {"UCP", "FECHA", "profile", "cluster"}
    for key, v in data.items():
        assert {r["FECHA"]: r["cluster"] for r in got if r["UCP"] == key} == plain(v, clusters, starts), key
    assert {r["cluster"] for r in got if r["UCP"] == "same"} == {0}


def test_rounds_on_an_empty_table(spark):
    assert H.lloyd_clusters(spark.createDataFrame([], SCHEMA), ["UCP"], 5).count() == 0


def test_rounds_come_near_the_seeded_fit(spark, data):
    def cost(df):
        x = df.where("UCP = 'a'").toPandas()
        return sum(((np.stack(g["profile"]) - np.stack(g["profile"]).mean(0)) ** 2).sum() for _, g in x.groupby("cluster"))

    days = spark.createDataFrame([(k, d, p, "x", 1) for k, v in data.items() for d, p in v], SCHEMA)
    assert cost(H.lloyd_clusters(days, ["UCP"], 5)) <= 1.1 * cost(H.cluster_days(days, ["UCP"], 5))
