"""Exact quantiles of groups of any size, in two passes over the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.session import stored


def _by_group(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """Join by group, nulls equal; without groups the right side is one row."""
    r = right.withColumnsRenamed({b: f"__r_{i}" for i, b in enumerate(by)})
    if not by:
        return left.join(F.broadcast(r), how=how, on=F.lit(True))  # one row
    pair = reduce(and_, [left[b].eqNullSafe(r[f"__r_{i}"]) for i, b in enumerate(by)])
    return left.join(r, pair, how).drop(*[f"__r_{i}" for i in range(len(by))])


def exact_quantiles(df: DataFrame, col: str, by: list[str], probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(by, n, a column for each entry of probs): linear quantiles of col, equal to `percentile`, and the count of values.

    `percentile` holds a group's distinct values in one task.  Here a mergeable sketch (percentile_approx, whose size depends
    on `accuracy` alone) gives two values that a quantile lies between; the second pass counts, with map-side sums, the rows
    below the two and each distinct value between them, and only these counts are ordered.  Of a group of n rows some
    6 n / accuracy values meet in a task, however often each repeats.  Where the counts say that a rank lies outside its
    bracket, brackets are widened eightfold and counted anew, at last to all values; the driver sees the number of such groups.

    Null and NaN aren't values.  A group without values has n = 0 and null quantiles; a null group is a group; no rows give no
    groups, or one row with n = 0 where `by` is empty.  Other columns are left out."""
    names = [f"__g{i}" for i in range(len(by))]
    v = F.col(col).cast("double")
    d = df.select(*[F.col(b).alias(g) for b, g in zip(by, names)], F.when(~F.isnan(v), v).alias("__v"))
    margin, qs = 3.0 / accuracy, list(probs.values())
    while True:
        ends = [x for q in qs for x in (max(q - margin, 0.0), min(q + margin, 1.0))]
        sketch = F.percentile_approx("__v", F.array(*[F.lit(x) for x in ends]), F.lit(accuracy))
        g = d.groupBy(*names).agg(F.count("__v").alias("__n"), sketch.alias("__s"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        # the ends of the sketch aren't always the least and the largest value
        edge = lambda k, q: F.col("__lo") if q <= 0.0 else F.col("__hi") if q >= 1.0 else F.get("__s", F.lit(k))
        g = stored(g.select(*names, "__n", F.array(*[F.struct(F.lit(i).alias("p"), edge(2 * i, ends[2 * i]).alias("lo"), edge(2 * i + 1, ends[2 * i + 1]).alias("hi")) for i in range(len(qs))]).alias("__b")), "brackets")
        rows = _by_group(d.where("__v is not null"), g.drop("__n"), names, "inner")
        near = F.transform(F.filter("__b", lambda b: F.col("__v") <= b["hi"]), lambda b: F.struct(b["p"].alias("p"), F.when(F.col("__v") >= b["lo"], F.col("__v")).alias("x")))
        counts = rows.select(*names, F.explode(near).alias("__e")).groupBy(*names, F.col("__e.p").alias("__p"), F.col("__e.x").alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
        upto = Window.partitionBy(*names, "__p").orderBy(F.col("__x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = (F.col("__n") - 1) * F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("__p") + 1)
        ranked = _by_group(counts.withColumn("__k", F.sum("__c").over(upto)), g.select(*names, "__n"), names, "inner").withColumn("__at", at)
        of = lambda rank: F.min(F.when(F.col("__x").isNotNull() & (F.col("__k") > rank), F.col("__x")))
        low, high = F.floor("__at"), F.ceil("__at")
        below = F.coalesce(F.max(F.when(F.col("__x").isNull(), F.col("__k"))), F.lit(0))
        found = ranked.groupBy(*names, "__p", "__at").agg(of(low).alias("__a"), of(high).alias("__z"), below.alias("__below"), F.max("__k").alias("__upto"))
        found = stored(found.withColumn("__ok", (F.col("__below") <= F.floor("__at")) & (F.col("__upto") > F.ceil("__at"))), "quantiles")
        if margin >= 1.0 or not found.where("not __ok").count():
            break
        margin *= 8
    value = F.when(F.col("__a") == F.col("__z"), F.col("__a")).otherwise((F.ceil("__at") - F.col("__at")) * F.col("__a") + (F.col("__at") - F.floor("__at")) * F.col("__z"))
    wide = found.groupBy(*names).agg(*[F.max(F.when(F.col("__p") == i, value)).alias(f"__q{i}") for i in range(len(qs))])
    out = _by_group(g.select(*names, "__n"), wide, names, "left")
    return out.select(*[F.col(g_).alias(b) for b, g_ in zip(by, names)], F.col("__n").alias("n"), *[F.col(f"__q{i}").alias(c) for i, c in enumerate(probs)])
