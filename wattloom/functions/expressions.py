"""Column expressions that several operators share.  All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.schema import HOURS


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is 0 or either is null."""
    return F.try_divide(part * 100.0, whole)


def row_sum(cols: list[str]) -> Column:
    """Sum over columns of one row; nulls count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])


def hours_array(cols: list[str] = HOURS) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def normalised(a: Column, total: Column | None = None) -> Column:
    """The 24 values as shares of their sum; null where the sum is 0.  A total that is a column already is
    used as it is: inside the lambda a sum would be written out, and worked out, once for each value."""
    total = array_sum(a) if total is None else total
    return F.when(total != 0, F.transform(a, lambda x: x / total))


def scaled(profile: Column, total: Column) -> Column:
    return F.transform(profile, lambda x: x * total)


def wide(a: Column, names: list[str] = HOURS) -> list[Column]:
    """The array's values as columns."""
    return [F.get(a, F.lit(k)).alias(c) for k, c in enumerate(names)]


def mean_profile(a: str, n: int = 24) -> Column:
    """Aggregate: the mean of each position of an array column, as one array."""
    return F.array(*[F.avg(F.get(F.col(a), F.lit(k))) for k in range(n)])


def to_double(c: str) -> Column:
    """The column as double; what isn't a number (NaN too) is null."""
    v = F.col(c).try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


def to_date(c: str) -> Column:
    return F.to_date(F.try_to_timestamp(F.col(c)))


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")
