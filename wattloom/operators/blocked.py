"""Running values of a key whose rows are too many for one task.

A window by key is one task a key.  Here the order is cut into blocks (months): one summary for each key and block is
combined before its shuffle, a window over these few summaries says what each block starts with, and the rows of a
block then run on their own after a row that holds its start.  So tasks are keys times blocks, the rows are shuffled once,
and what a window by key holds is one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_number(date: str) -> Column:
    return F.year(date) * 12 + F.month(date)


def running(df: DataFrame, keys: list[str], order: str, inputs: dict[str, Column], combine: Callable[[Column], Column], block: Column | None = None, strict: bool = False) -> DataFrame:
    """df with a column for each input: `combine` of it over the key's rows up to this row's `order`, rows of the same
    order included (strict: over the rows before this one; among equal orders which come before is not defined).
    combine is an aggregate that may be applied to its own results (max, min, sum).  `block` must not fall as
    `order` rises, and is the month of a date where it isn't given.  Null keys are a key; rows with a null order come
    first.  No rows give no rows."""
    held = {n: f"__in_{k}" for k, n in enumerate(inputs)}
    d = df.withColumns({"__block": month_number(order) if block is None else block, **{held[n]: c for n, c in inputs.items()}})
    per_block = d.groupBy(*keys, "__block").agg(*[combine(F.col(h)).alias(h) for h in held.values()])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.withColumns({h: combine(F.col(h)).over(before) for h in held.values()})
    rows = d.withColumn("__row", F.lit(True)).unionByName(starts.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__block").orderBy("__row", order)
    w = w.rowsBetween(Window.unboundedPreceding, -1) if strict else w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({n: combine(F.col(h)).over(w) for n, h in held.items()}).where("__row").drop("__row", "__block", *held.values())


def _dated(value: str, order: str) -> Column:
    """The value with its date, so that a running maximum is the latest; of a date that repeats the largest value counts."""
    return F.struct(F.col(order).alias("at"), F.col(value).alias("v"))


def _known(value: str, order: str) -> Column:
    return F.when(F.col(value).isNotNull() & F.col(order).isNotNull(), _dated(value, order))


def fill_forward(df: DataFrame, keys: list[str], cols: list[str], order: str = "FECHA", block: Column | None = None) -> DataFrame:
    """The last known value, then 0, as features.fill_forward.  A row's own value stays, also where its date is null;
    such a row passes nothing on."""
    d = running(df, keys, order, {f"__last_{k}": _known(c, order) for k, c in enumerate(cols)}, F.max, block)
    return d.withColumns({c: F.coalesce(c, f"__last_{k}.v", F.lit(0)) for k, c in enumerate(cols)}).drop(*[f"__last_{k}" for k in range(len(cols))])


def day_change(df: DataFrame, keys: list[str], value: str = "TOTAL", order: str = "FECHA", block: Column | None = None) -> DataFrame:
    """Change to the row before, plain and in percent, as features.day_change: the latter carries the last known value
    over gaps and is null on a base of 0.  A key's dates are unique."""
    d = running(df, keys, order, {"__row_before": _dated(value, order), "__known_before": _known(value, order)}, F.max, block, strict=True)
    base = F.col("__known_before.v")
    change = F.col(value) - F.col("__row_before.v")
    pct = F.try_divide((F.coalesce(F.col(value), base) - base) * 100.0, base)
    return d.withColumns({f"{value.lower()}_day_change": change, f"{value.lower()}_day_change_pct": pct}).drop("__row_before", "__known_before")


def as_of(targets: DataFrame, history: DataFrame, keys: list[str], at: str, values: list[str], date: str = "FECHA", block: Column | None = None) -> DataFrame:
    """targets with history's values on the date `at`, else of the latest day before, else of the key's first day, else
    0, as forecast.as_of.  A known day whose value is null stays null; of repeated dates the largest struct counts.
    `block` is of the column `__at`, which holds both sides' dates.  A null key or date of a target meets no day before."""
    h = history.where(F.col(date).isNotNull()).select(*keys, F.col(date).alias("__at"), F.struct(F.col(date).alias("d"), *[F.col(c).alias(c) for c in values]).alias("__v"))
    first = h.groupBy(*keys, "__at").agg(F.max("__v").alias("__v")).groupBy(*keys).agg(F.min("__v").alias("__first"))
    t = targets.select(*keys, F.col(at).alias("__at")).distinct()
    both = h.withColumn("__t", F.lit(False)).unionByName(t.withColumn("__t", F.lit(True)), allowMissingColumns=True)
    found = running(both, keys, "__at", {"__f": F.col("__v")}, F.max, block).where("__t").select(*keys, F.col("__at").alias(at), "__f")
    d = targets.drop(*[c for c in values if c in targets.columns]).join(found, [*keys, at], "left").join(first, keys, "left")
    got = F.coalesce("__f", "__first")
    return d.withColumns({c: F.when(got.isNull(), F.lit(0.0)).otherwise(got[c]) for c in values}).drop("__f", "__first")
