"""SimHash document fingerprints and permuted block tables (operator 4)."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import P, stored

#: Terms whose bits are laid out at once; bounds memory for texts of any length.
TERMS = 1 << 16
#: The 64 bits in six blocks, low to high: (shift, bits).
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
#: Fingerprints in one row of a table bucket.
CHUNK = 1024


def fingerprint(text: str, seed: int = 7) -> int:
    """Terms are pairs of neighbouring words in lower case (one word alone is its own term), weighted by
    1 + ln(count).  Each term's hash votes with its weight for the bits that it has and against the
    others; positive sums make the fingerprint.  A text without words has fingerprint 0."""
    from xxhash import xxh64_intdigest

    words = text.lower().encode("utf-8", "replace").split()
    terms = Counter(zip(words, words[1:])) if len(words) > 1 else Counter([tuple(words)] if words else [])
    if not terms:
        return 0
    h = np.fromiter((xxh64_intdigest(b" ".join(t), seed) for t in terms), np.uint64, len(terms))
    w = 1 + np.log(np.fromiter(terms.values(), np.float64, len(terms)))
    w = np.round(w * 4096)  # whole numbers: the sums don't depend on the order of terms
    total = np.zeros(64)
    for k in range(0, len(h), TERMS):
        bits = np.unpackbits(h[k : k + TERMS].view(np.uint8), bitorder="little").reshape(-1, 64)
        total += w[k : k + TERMS] @ (bits * 2.0 - 1)
    return int(((total > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def edited(text: str, other: str) -> str:
    """The last half (rounded down) of the text's code points replaced by as many of the other's first."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_ROW = "part int, kind int, {k} {t}, n_chars bigint, sha string, fp bigint, fp_edited bigint, fp_next bigint, body string"


def _done(key, text: str, fp: int, nxt: str, fp_next: int) -> tuple:
    new = edited(text, nxt)
    return (key, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), _signed(fp), _signed(fingerprint(new)), _signed(fp_next))


def with_next(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fp, fp_edited, fp_next) for every row: fingerprints of the whole text,
    of its edited text, and of the next row's text.  Next is by key, descending; after the last comes the
    first.  Null keys come last, rows with one key by a hash of their text; a null text is empty; a table's only row is
    its own next.

    One range shuffle by key puts neighbours side by side; each task works through its sorted rows as a
    stream.  A task's last row needs the next task's first: both are written with the results, and a
    second step over these (two a task) joins them."""
    src = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(f"{P}t"))
    kind = src.schema[0].dataType.simpleString()
    order = [F.col(key).desc_nulls_last(), f"{P}h1", f"{P}h2", f"{P}id"]  # a key or a text of any share of the rows is so cut over tasks
    named = src.withColumns({f"{P}h1": F.xxhash64(f"{P}t"), f"{P}h2": F.xxhash64(F.lit(1), f"{P}t"), f"{P}id": F.monotonically_increasing_id()})
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _ROW.format(k=f"`{key}`", t=kind)

    def table(rows: list[tuple], key_type) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), key_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "kind", key, "n_chars", "sha", "fp", "fp_edited", "fp_next", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key_type, part = None, None, 0
        for b in batches:
            rows = []
            for p, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = t.as_py()
                fp = fingerprint(t)
                if held is None:
                    part, key_type = p, b.column(1).type
                    rows.append((p, 1, k, None, None, _signed(fp), None, None, t))
                else:
                    rows.append((p, 0, *_done(*held, t, fp), None))
                held = (k, t, fp)
            if rows:
                yield table(rows, key_type)
        if held is not None:
            yield table([(part, 2, held[0], None, None, _signed(held[2]), None, None, held[1])], key_type)

    out = stored(dealt.select(F.spark_partition_id().alias("part"), key, f"{P}t").mapInArrow(run, schema), "fingerprints")
    heads = out.where("kind = 1").select(F.col("part").alias("head"), F.col("body").alias("next"), F.col("fp").alias("fp_next"))
    parts = out.where("kind = 1").select("part")  # one row a task
    follows = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("head"))
    last = out.where("kind = 2").select("part", key, "body", "fp").join(follows, "part").join(heads, "head").select(key, "body", "fp", "next", "fp_next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(0, 0, *_done(k, t, fp & (2**64 - 1), n, f & (2**64 - 1)), None) for k, t, fp, n, f in zip(*(c.to_pylist() for c in b.columns))]
            if rows:
                yield table(rows, b.column(0).type)

    cols = [F.col(key), "n_chars", F.col("sha").alias("edited_sha256"), "fp", "fp_edited", "fp_next"]
    return out.where("kind = 0").select(*cols).unionByName(last.mapInArrow(finish, schema).select(*cols))


def likeness(a: str, b: str) -> F.Column:
    """The share of the 64 bits that two fingerprints agree on."""
    return (1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64).cast("double")


def near_counts(fps: DataFrame, asked: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, near) for each distinct `fp` of asked: how many rows of fps (fp) lie within `radius` bits (at
    most 3), by permuted block tables.

    Up to three differing bits leave three of six blocks as they are, so for each choice of three blocks
    one table leads with these (about 32 bits); rows that agree with a query there are its candidates.
    Table buckets are rows of up to about CHUNK distinct fingerprints with their counts, more rows where a
    bucket is larger, so no bucket is one task or a list of pairs; a candidate counts in the first table
    that it is met in."""
    assert radius <= len(BLOCKS) - 3
    masks = [((1 << n) - 1) << s for s, n in BLOCKS]
    tables = [(sum(1 << k for k in c), sum(masks[k] for k in c)) for c in combinations(range(len(BLOCKS)), 3)]
    keys = lambda fp: F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in tables])
    distinct = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    rows = distinct.select("fp", "n", F.explode(keys(F.col("fp"))).alias("e")).select("fp", "n", "e.t", "e.k")
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.where(F.col("m") > CHUNK).select(F.col("t").alias("t2"), F.col("k").alias("k2"), F.ceil(F.col("m") / CHUNK).alias("parts"))
    salted = rows.join(large, (F.col("t") == F.col("t2")) & (F.col("k") == F.col("k2")), "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))))
    buckets = salted.groupBy("t", "k", "salt").agg(F.collect_list(F.struct("fp", "n")).alias("own"))
    q = asked.select(F.col("fp").alias("q")).distinct().select("q", F.explode(keys(F.col("q"))).alias("e")).select("q", "e.t", "e.k")

    def counted(x):
        apart = x["fp"].bitwiseXOR(F.col("q"))
        left = F.lit(0)
        for k, m in enumerate(masks):
            left = left + F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(1 << k)).otherwise(F.lit(0))
        return F.when((F.bit_count(apart) <= radius) & (F.col("first")[left] == F.col("t")), x["n"]).otherwise(F.lit(0).cast("long"))

    # for each set of intact blocks the table that has its three lowest
    first = [sum(1 << k for k in sorted(b for b in range(6) if s >> b & 1)[:3]) for s in range(64)]
    # merged, as both sides grow with the rows
    met = q.hint("merge").join(buckets, ["t", "k"]).withColumn("first", F.array(*[F.lit(x) for x in first]))
    near = met.select("q", F.aggregate("own", F.lit(0).cast("long"), lambda acc, x: acc + counted(x)).alias("c"))
    return near.groupBy("q").agg(F.sum("c").alias("near")).withColumnRenamed("q", "fp")
