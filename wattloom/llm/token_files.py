"""Token-ID files: ids of whole texts in coded, checksummed blocks, written and read back (operator 9)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.common import P, stored
from wattloom.llm.range_coder import BLOCK, LANES, WHOLE, decode_blocks, encode_blocks, shares_of

MAGIC = b"WLT3"  # files of WLT1 and WLT2 were coded otherwise, and are refused
#: Ids stay below this.
MOST = 65535
#: Ids in a segment, from which on the next document starts another.
SEGMENT = 512 * LANES
#: Bytes of texts that are encoded together, so that each distinct run of letters is looked up once.
TOGETHER = 8 << 20
_HEAD = struct.Struct("<4sIQIIII")  # magic, documents, ids, ids in a block, blocks, bytes of the index, its crc32
_BLOCK = struct.Struct("<II")  # bytes, crc32


def write_segment(keys: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """Head, index (keys and id counts of the documents, the ids' shares), then each block's length, checksum and code."""
    block = 256
    while block < BLOCK and len(ids) > block * LANES // 2:
        block *= 2
    shares = shares_of(ids)
    index = zlib.compress(np.array([k is None for k in keys], np.uint8).tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + np.array(counts, "<i8").tobytes() + shares.astype("<u2").tobytes(), 1)
    codes = encode_blocks(ids, block, shares)
    return b"".join([_HEAD.pack(MAGIC, len(keys), len(ids), block, len(codes), len(index), zlib.crc32(index)), index, *(x for c in codes for x in (_BLOCK.pack(len(c), zlib.crc32(c)), c))])


def read_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, counts, ids); raises ValueError where a checksum or the head is wrong."""
    magic, docs, total, block, blocks, size, crc = _HEAD.unpack_from(raw)
    at = _HEAD.size
    index = raw[at : at + size]
    if magic != MAGIC or zlib.crc32(index) != crc:
        raise ValueError("token file: bad head or index")
    plain = zlib.decompress(index)
    none = np.frombuffer(plain, np.uint8, docs)
    keys = [None if x else k for x, k in zip(none.tolist(), np.frombuffer(plain, "<i8", docs, docs).tolist())]
    counts = np.frombuffer(plain, "<i8", docs, 9 * docs)
    shares = np.frombuffer(plain, "<u2", WHOLE, 17 * docs)
    at += size
    codes = []
    for k in range(blocks):
        n, crc = _BLOCK.unpack_from(raw, at)
        at += _BLOCK.size
        codes.append(raw[at : at + n])
        at += n
        if zlib.crc32(codes[-1]) != crc:
            raise ValueError(f"token file: bad checksum in block {k}")
    return keys, counts, decode_blocks(codes, total, block, shares)


def segments(batches: Iterator[pa.RecordBatch], encoder, end_id: int, most: int = SEGMENT, together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """(part, seq, segment) of a task's rows (part, key, text); a segment ends with the document that brings it to `most` ids."""
    seq = part = held = 0
    keys: list = []
    counts: list[int] = []
    ids: list[np.ndarray] = []

    def segment() -> pa.RecordBatch:
        raw = write_segment(keys, counts, np.concatenate(ids))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([raw], pa.binary())], names=["part", "seq", "segment"])

    for b in batches:
        sizes, at = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False)), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + together, side="right")))
            part, own_keys, texts = b.column(0)[at].as_py(), b.column(1)[at:to].to_pylist(), b.column(2)[at:to].to_pylist()
            wide, n = encoder.encode_all(texts, end_id)
            if wide.max() >= MOST:
                raise ValueError(f"token file: id {wide.max()}; the coder takes ids below {MOST}")
            own, ends, done, before = wide.astype(np.uint16), np.cumsum(n), 0, 0
            while done < len(n):
                upto = min(len(n), int(np.searchsorted(ends, before + most - held)) + 1)
                keys += own_keys[done:upto]
                counts += n[done:upto].tolist()
                ids.append(own[before : ends[upto - 1]])
                held += int(ends[upto - 1]) - before
                done, before = upto, int(ends[upto - 1])
                if held >= most:
                    yield segment()
                    keys, counts, ids, held, seq = [], [], [], 0, seq + 1
            at = to
    if keys:
        yield segment()


def write(df: DataFrame, text: str = "text", key: str = "doc_id", *, tokenizer: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """The files, as rows (part, seq, segment) that Spark writes to `path` (a folder of Parquet files, which must not
    be there yet) or else to the shared store: ids of the whole texts and end_id after each, in ascending order of
    the key (nulls first, rows with one key by a hash of their text).  Ids must be below MOST.

    One range shuffle; a task's sorted rows are encoded as a stream, a segment at a time.  A null text is
    empty; repeated rows are documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wattloom.llm.tokens import encoder

        return segments(batches, encoder(tokenizer), end_id)

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(f"{P}t"))
    order = [F.col("key").asc_nulls_first(), f"{P}h1", f"{P}h2", f"{P}id"]  # a key or a text of any share of the rows is so cut over tasks
    named = src.withColumns({f"{P}h1": F.xxhash64(f"{P}t"), f"{P}h2": F.xxhash64(F.lit(1), f"{P}t"), f"{P}id": F.monotonically_increasing_id()})
    dealt = named.repartitionByRange(*order).sortWithinPartitions(*order)
    files = dealt.select(F.spark_partition_id().alias("part"), "key", f"{P}t").mapInArrow(run, "part int, seq int, segment binary")
    return stored(files, "token-files", path)


def read(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of each document in the files; `start` counts the ids of all
    documents before it, from the files' totals by prefix sums (a row for each segment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                keys, counts, ids = read_segment(raw.as_py())
                wide, ends = ids.astype("<u4"), np.cumsum(counts)
                starts = ends - counts
                for q in range(0, len(keys), 2048):
                    own = [wide[a:z].tobytes() for a, z in zip(starts[q : q + 2048], ends[q : q + 2048])]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(keys[q : q + 2048], pa.int64()), pa.array(starts[q : q + 2048]), pa.array(counts[q : q + 2048]), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())], names=["part", "seq", "key", "within", "n_tokens", "ids_crc32", "ids"])

    # a segment's total stands in its head, after the magic and the number of documents
    total = F.conv(F.concat(*[F.hex(F.substring(F.col("segment"), F.lit(k), F.lit(1))) for k in range(16, 8, -1)]), 16, 10).cast("long")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", "seq", total.alias("total")).select("part", "seq", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    docs = files.mapInArrow(run, "part int, seq int, key bigint, within bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return docs.join(F.broadcast(base), ["part", "seq"]).select(F.col("key").alias(key), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "ids")
