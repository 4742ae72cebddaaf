"""SimHash near-duplicates by multi-index hashing (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import P, components, stored

LANES = np.uint64(0x0101010101010101)
#: Hashes that are voted on at once; bounds a worker's memory for texts of any length.
VOTE = 1 << 19
#: Fingerprints that share one bucket before it counts as hot.
HOT = 64


def bit_votes(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """How many of each document's hashes have each of the 64 bits: (docs, 64).  `doc` is ascending.
    Each document is laid out in rows of 64 hashes; eight bits at a time are added up in byte lanes."""
    out = np.zeros((docs, 64), np.int64)
    if not len(h):
        return out
    n = np.bincount(doc, minlength=docs)
    rows = -(-n // 64)
    first = np.concatenate([[0], np.cumsum(rows)[:-1]])
    place = np.arange(len(h)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.repeat(first * 64, n)
    flat = np.zeros(int(rows.sum()) * 64, np.uint64)
    flat[place] = h
    grid = flat.reshape(-1, 64)
    some = rows > 0
    for k in range(8):
        sums = ((grid >> np.uint64(k)) & LANES).sum(axis=1, dtype=np.uint64)
        by_byte = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[np.ix_(some, np.arange(8) * 8 + k)] = np.add.reduceat(by_byte, first[some], axis=0)
    return out


def shingle_parts(text: bytes, words: int) -> Iterator[list[int]]:
    """shingle_hashes in lists of VOTE at most."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if len(w) < words:
        yield [xxh64_intdigest(b" ".join(w), 42)] if w else []
    for k in range(0, len(w) - words + 1, VOTE):
        yield list(map(xxh64_intdigest, map(b" ".join, zip(*(w[k + j : k + j + min(VOTE, len(w) - words + 1 - k)] for j in range(words)))), repeat(42)))


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of the text's word shingles, A-Z in lower case, repeats included."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # on bytes: A-Z only, and space with 0x09 to 0x0D
    if len(w) < words:
        return [xxh64_intdigest(b" ".join(w), 42)] if w else []
    return list(map(xxh64_intdigest, map(b" ".join, zip(*(w[k:] for k in range(words)))), repeat(42)))


def simhash(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bit k is set where more than half of the n hashes have it."""
    return ((votes * 2 > n[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(df: DataFrame, text: str = "text", keep: str = "doc_id", words: int = 3) -> DataFrame:
    """(keep, fp): the 64-bit SimHash of every whole text as a bigint; 0 for a null text or one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.zeros((b.num_rows, 64), np.int64)
            count = np.zeros(b.num_rows, np.int64)
            h: list[int] = []
            doc: list[np.ndarray] = []
            for k, t in enumerate(b.column(1)):
                body = t.as_py()
                for own in [shingle_hashes(body, words)] if len(body) < VOTE else shingle_parts(body, words):
                    count[k] += len(own)
                    h += own
                    doc.append(np.full(len(own), k))
                    if len(h) >= VOTE:
                        total += bit_votes(np.fromiter(h, np.uint64, len(h)), np.concatenate(doc), b.num_rows)
                        h, doc = [], []
            if h:
                total += bit_votes(np.fromiter(h, np.uint64, len(h)), np.concatenate(doc), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhash(total, count).view(np.int64))], names=[keep, "fp"])

    src = df.select(F.col(keep), F.coalesce(F.col(text), F.lit("")).cast("binary").alias(f"{P}t"))
    return src.mapInArrow(run, f"`{keep}` {src.schema[0].dataType.simpleString()}, fp bigint")


def _flips(bits: range, only_clear: bool = False):
    """`fp` with each one of the bits flipped; only_clear: only bits that are 0, so that of two values one bit apart one alone names the other."""
    masks = F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in bits])
    if only_clear:
        masks = F.filter(masks, lambda m: F.col("fp").bitwiseAND(m) == 0)
    return F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))


def near_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints `fp` at two or fewer differing bits.

    Multi-index hashing over two segments of 32 bits: of at most two differing bits, the upper segment has
    one at most (found by its ball of radius 1), or both and then the lower segment is equal (radius 0).
    Tables are met by equi-joins, the whole distance is verified, and every pair is met once from each
    table.  A table bucket with more than `hot` fingerprints isn't paired: all fingerprints that are in one
    or ask for one are linked through the 65 values within one bit of each instead, which two fingerprints
    share exactly if two bits or fewer divide them; a shared value has 65 owners at most."""
    upper = lambda c: F.shiftrightunsigned(c, 32).bitwiseOR(F.lit(1 << 32))  # noqa: E731  the bit names the table
    lower = lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    entries = fps.select("fp", F.explode(F.array(upper(F.col("fp")), lower("fp"))).alias("k"))
    asked = F.concat(F.array(upper(F.col("fp")), lower("fp")), F.transform(_flips(range(32, 64), True), upper))
    asks = fps.select("fp", F.explode(asked).alias("k"))
    hot_keys = entries.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("k")
    cool = entries.join(hot_keys, "k", "left_anti").select(F.col("fp").alias("g"), F.col("k").alias("k2"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("g")))
    # within one bucket each pair comes up from both sides: keep it from one
    once = (F.col("k") != upper(F.col("fp"))) & (F.col("k") != lower("fp")) | (F.col("fp") < F.col("g"))
    paired = asks.join(cool, (F.col("k") == F.col("k2")) & (apart <= 2) & (F.col("fp") != F.col("g")) & once).select(F.col("fp").alias("a"), F.col("g").alias("b"))
    within = asks.join(hot_keys, "k", "left_semi").select("fp").distinct()
    balls = within.select("fp", F.explode(F.concat(F.array("fp"), _flips(range(64)))).alias("v"))
    shared = balls.groupBy("v").agg(F.collect_set("fp").alias("s")).where(F.size("s") > 1)
    star = shared.select(F.array_min("s").alias("a"), F.explode("s").alias("b")).where(F.col("a") != F.col("b"))
    return paired.unionByName(star).distinct()


def near_duplicates(df: DataFrame, text: str = "text", keep: str = "doc_id", words: int = 3) -> DataFrame:
    """(keep, fp, component_id) for every row: component_id is the least key of the rows reachable over links
    between fingerprints at two or fewer differing bits, itself included.

    Equal fingerprints are one node, so copies cost no pairs.  Repeated rows and keys stay rows; a null key
    takes part in links and names no component (null if all keys of a component are null); extra columns
    aren't read."""
    fp = stored(fingerprints(df, text, keep, words), "simhash")
    nodes = stored(fp.groupBy("fp").agg(F.min(keep).alias("first")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp")))
    linked = nodes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.select("fp", "root").join(least, "root").select(F.col("fp").alias(f"{P}fp"), "component_id")
    return fp.join(named, F.col("fp") == F.col(f"{P}fp")).select(keep, "fp", "component_id")


def hex16(c: str) -> F.Column:
    return F.lpad(F.lower(F.hex(F.col(c))), 16, "0")
