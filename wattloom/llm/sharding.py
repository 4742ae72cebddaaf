"""Proportional stratified interleaving: shards that all hold the table's mixture (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import P, buckets_for, dense_rank_by_hash


def interleave(df: DataFrame, source: str = "source", *, shards: int = 16, seed: int = 17, key: list[str] | None = None) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (0-based place in the shard) to every row.

    Rows are ranked within their source in a seeded order; (rank + u) / rows of the source places them on (0, 1), with u
    from a seeded hash of the source, so that many sources of a few rows spread over all shards; the table sorted by that place is cut into `shards` runs whose row counts differ by one at
    most.  Each run so holds every source in proportion, to within a row or two.  Both ranks come from counts by hash
    range and ranks inside a range, so a source with a third of all rows is spread over many tasks and
    no global sort is needed.  `key` names the columns that order rows (default: all but source); rows
    alike in all of them may trade places.  A null source is a source of its own.  The caller projects
    away what it doesn't need, since rows are shuffled twice; an empty table stays empty."""
    cols = df.columns
    total = df.count()
    key = key or [c for c in cols if c != source]
    n = buckets_for(total)
    d = df.withColumn(f"{P}h", F.xxhash64(F.lit(seed), *key)).withColumn(f"{P}src", F.col(source))
    per = d.groupBy(f"{P}src").agg(F.count(F.lit(1)).alias(f"{P}cnt")).withColumnRenamed(f"{P}src", f"{P}s2")
    d = dense_rank_by_hash(d, f"{P}src", f"{P}h", f"{P}rank", buckets=n, ties=key)
    d = d.join(per, F.col(f"{P}src").eqNullSafe(F.col(f"{P}s2")))
    # the place on (0, 1) as a signed bigint that keeps its order: near uniform, so the same bucket ranks apply
    u = (F.pmod(F.xxhash64(F.lit(seed + 1), F.col(f"{P}src")), F.lit(2**20)) + 0.5) / float(2**20)
    place = ((F.col(f"{P}rank") + u) / F.col(f"{P}cnt") - 0.5) * float(2**63)
    d = d.withColumn(f"{P}f", F.when(place >= 9.2e18, F.lit(2**63 - 1)).when(place <= -9.2e18, F.lit(-(2**63))).otherwise(place.cast("long"))).withColumn(f"{P}one", F.lit(0))
    d = dense_rank_by_hash(d, f"{P}one", f"{P}f", f"{P}at", buckets=n, ties=[f"{P}h", f"{P}src", *key])
    # the first `total mod shards` shards have one row more
    low, more = divmod(total, shards)
    at = F.col(f"{P}at")
    big = more * (low + 1)
    shard = F.when(at < big, F.floor(at / (low + 1))).otherwise(more + F.floor((at - big) / max(low, 1))).cast("int")
    first = F.col("shard") * low + F.least(F.col("shard"), F.lit(more))
    out = d.select(*[F.col(c) for c in cols if c not in ("shard", "slot")], at.alias(f"{P}at"), shard.alias("shard"))
    return out.withColumn("slot", (F.col(f"{P}at") - first).cast("long")).drop(f"{P}at")
