"""One description of a result's columns for Spark and SQL: `name`, or `name:kind` with s text, r double
rounded to four places, i bigint, b boolean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import prepare

#: Added before rounding: sums of values with a few decimals end in a 5 at times, and two engines that add in
#: another order then round to different sides.
OFF_TIES = 0.00000037


def _parts(spec: str) -> list[tuple[str, str]]:
    return [tuple((x.strip() + ":").split(":")[:2]) for x in spec.split(",")]


def spark_shape(df: DataFrame, spec: str) -> DataFrame:
    make = {"s": lambda c: c.cast("string"), "r": lambda c: F.round(c.cast("double") + F.lit(OFF_TIES), 4) + F.lit(0.0), "i": lambda c: c.cast("bigint"), "b": lambda c: c.cast("boolean"), "": lambda c: c}
    return df.select(*[make[k](F.col(f"`{n}`")).alias(n) for n, k in _parts(spec)])


def sql_shape(sql: str, spec: str) -> str:
    make = {"s": "CAST({} AS VARCHAR)", "r": f"ROUND(CAST({{}} AS DOUBLE) + {OFF_TIES}, 4) + 0.0", "i": "CAST({} AS BIGINT)", "b": "CAST({} AS BOOLEAN)", "": "{}"}
    cols = ", ".join(make[k].format(f'"{n}"') + f' AS "{n}"' for n, k in _parts(spec))
    return f"SELECT {cols} FROM ({sql}) AS result"


class Registry:
    """Queries and their SQL, registered side by side."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, spec: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = lambda spark, sf_dir: spark_shape(fn(prepare(spark), sf_dir), spec)
            if sql is not None:
                self.sql[name] = sql_shape(sql, spec)
            return fn

        return register
