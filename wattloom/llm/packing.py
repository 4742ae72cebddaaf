"""Concatenate and cut: whole texts as ids, one stream, windows of fixed length (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import ARROW_BYTES, P, stored


def encoded(df: DataFrame, text: str, keep: str, tokenizer: str, end_id: int, out_batch: int = ARROW_BYTES) -> DataFrame:
    """First pass, a map without a shuffle: each row of `df` as (part, start, keep, n, ids).  `ids` holds the
    whole text's ids and then end_id as little-endian unsigned 32-bit integers; `start` is the number of ids
    before the row in its partition `part`.  A null text counts as empty and leaves the end id alone."""
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wattloom.llm.tokens import encoder

        e, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held = 0

        def batch():
            start, key, n, ids = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(start, pa.int64()), pa.array(key, key_type), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["part", "start", keep, "n", "ids"])

        for b in batches:
            key_type = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = e.encode(text.as_py()) + end
                n = len(ids) >> 2
                rows.append((at, key, n, ids))
                at += n
                held += len(ids)
                if held >= out_batch:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    src = df.select(F.col(keep), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(f"{P}t"))
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(encode, f"part bigint, start bigint, `{keep}` {kind}, n bigint, ids binary")


def pack(df: DataFrame, text: str = "text", keep: str = "doc_id", *, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Packs every row of df into sequences of `length` ids, and returns one row for each piece:
    keep, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Pass one encodes and numbers ids within each input partition and writes that; the totals of the
    partitions (one row each, so at most as many as the scan has splits) give each partition its place in
    the stream by prefix sums; pass two cuts the stream every `length` ids.  A document that spans a border
    leaves one piece on either side.  Only the last sequence of all has padding.  Rows that repeat, and
    null or repeated keys, are documents of their own; an empty table gives no piece."""
    rows = stored(encoded(df, text, keep, tokenizer, end_id), "packing")
    totals = rows.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    at = rows.join(F.broadcast(base), "part").withColumn(f"{P}g", F.col("base") + F.col("start"))  # 16 bytes a partition
    lo = lambda q: F.greatest(q * length, F.col(f"{P}g"))
    hi = lambda q: F.least((q + 1) * length, F.col(f"{P}g") + F.col("n"))
    own = lambda q: F.substring(F.col("ids"), ((lo(q) - F.col(f"{P}g")) * 4 + 1).cast("int"), ((hi(q) - lo(q)) * 4).cast("int"))
    first, last = F.floor(F.col(f"{P}g") / length), F.floor((F.col(f"{P}g") + F.col("n") - 1) / length)
    piece = lambda q: F.struct(
        (lo(q) - F.col(f"{P}g")).alias("start"), (hi(q) - lo(q)).alias("length"), F.crc32(own(q)).alias("ids_crc32"),
        q.alias("sequence_id"), (lo(q) - q * length).alias("offset"), own(q).alias("ids"),
    )
    cut = at.select(F.col(keep), F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first.cast("long"), last.cast("long")), piece)).alias("p"))
    return cut.select(keep, "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")
