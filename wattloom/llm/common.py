"""Helpers that the training-data operators share: scratch tables, ranks without one big task, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prefix of every working column, so that extra columns of the input can't clash.
P = "__wl_"

#: `[^\x20\x09-\x0D]+`: a word, as the contracts of operators 7 and 8 define it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only where a local session names
    none (tests) a folder of our own is made, set as the checkpoint folder and removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="wattloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


#: Bytes of texts that go to a Python worker at once, in stages that hand on whole texts.
ARROW_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """While it holds, Arrow batches end at ARROW_BYTES; the session's own limit comes back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder (or to `path`) and read back: lineage ends here, lost executors
    cost nothing that lies before, and what is used twice is computed once."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a session: what tasks import need not lie on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_wattloom_sent", False):
        return
    root = Path(__file__).resolve().parents[2]
    d = tempfile.mkdtemp(prefix="wattloom-")  # the driver serves the file for as long as it runs
    atexit.register(shutil.rmtree, d, True)
    out = f"{d}/wattloom-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.glob("wattloom/**/*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(out)
    sc._wattloom_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def safe_cols(df: DataFrame, keep: dict[str, Column | str]) -> DataFrame:
    """Only the named inputs, under working names; whatever else the table has can't get in the way."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in keep.items()])


#: Bytes of texts in a part of the documents, and the least number of parts.
PART_BYTES, LEAST_PARTS = 4 << 20, 64


def dealt(df: DataFrame, text: str, key: str, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """(part, key, text as bytes) of every row, and the number of parts: parts of about part_bytes, by
    a hash of key and text, each whole in a task.  The number of parts follows the bytes of all texts, so a part stays as large as it is on any input.  Several
    passes over the result within one query share its shuffle."""
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0  # one number
    parts = max(LEAST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    part = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(parts)).cast("int")
    return df.select(part.alias("part"), F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).repartition(parts, "part"), parts


def dense_rank_by_hash(df: DataFrame, group: str, order: str, out: str, weight: str | None = None, buckets: int = 1024, ties: list[str] | None = None) -> DataFrame:
    """Adds `out`: the 0-based rank of a row in its group by `order` (a uniform bigint), and, with weight,
    `out`_sum: the weights before it.  A group of any size is cut into `buckets` ranges of its order;
    counts by range are summed first, so no task holds a whole group.  `buckets` is a power of two."""
    shift = 64 - (buckets.bit_length() - 1)
    cut = df.withColumn(f"{P}b", F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(2**63))), shift) if buckets > 1 else F.lit(0).cast("long"))
    w = F.coalesce(F.col(weight), F.lit(0)).cast("long") if weight else F.lit(0).cast("long")
    sizes = cut.groupBy(group, f"{P}b").agg(F.count(F.lit(1)).alias(f"{P}n"), F.sum(w).alias(f"{P}w"))
    before = Window.partitionBy(group).orderBy(f"{P}b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(
        F.col(group).alias(f"{P}g"), F.col(f"{P}b").alias(f"{P}b2"),
        F.coalesce(F.sum(f"{P}n").over(before), F.lit(0)).alias(f"{P}n0"), F.coalesce(F.sum(f"{P}w").over(before), F.lit(0)).alias(f"{P}w0"),
    )
    inside = Window.partitionBy(group, f"{P}b").orderBy(order, *(ties or []))
    ranked = cut.withColumn(f"{P}r", F.row_number().over(inside) - 1)
    if weight:
        ranked = ranked.withColumn(f"{P}s", F.coalesce(F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(base, F.col(group).eqNullSafe(F.col(f"{P}g")) & (F.col(f"{P}b") == F.col(f"{P}b2")), "left")
    ranked = ranked.withColumn(out, (F.col(f"{P}n0") + F.col(f"{P}r")).cast("long"))
    if weight:
        ranked = ranked.withColumn(f"{out}_sum", (F.col(f"{P}w0") + F.col(f"{P}s")).cast("long"))
    return ranked.drop(*[f"{P}{x}" for x in ("b", "b2", "g", "r", "s", "n0", "w0")])


def buckets_for(rows: int, per_bucket: int = 20_000, least: int = 256) -> int:
    """A power of two such that a range of a group holds about per_bucket rows at most."""
    return 1 << max(least.bit_length() - 1, (max(1, rows // per_bucket)).bit_length())


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge list of bigints: (node, root), root the least node reachable; nodes
    without an edge don't appear.  Alternating large-star and small-star steps, each a pre-aggregated
    minimum and one join, whose lineage is cut by checkpoint(); nothing but two counters reaches the driver."""
    spark = edges.sparkSession
    shared_dir(spark)
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    digest = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = digest(e)
    for _ in range(rounds):
        if not last[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct().checkpoint()
        now = digest(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
