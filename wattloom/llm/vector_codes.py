"""Product codes of vectors with exact integer codebooks and memoised grid cells (operator 12).

Each part of a vector lies in a cell of a coarse grid.  For a cell that it meets first, a worker finds the codebook
entries that can be nearest to any point of it: those whose least distance to the cell's box isn't above the smallest
largest distance of all entries.  These are kept by cell, and a part is compared exactly with its cell's alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import P, ship, stored

#: Entries of a codebook, parts of a vector, rounds, and the factor that makes components integers.
ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Cells that a worker keeps for each part; numbers that it compares at once.
CELLS, BLOCK = 1 << 16, 1 << 20


def bounds(dims: int, parts: int = PARTS) -> list[int]:
    """Where the parts start and end; equal where the dimensions can be divided."""
    return [dims * k // parts for k in range(parts + 1)]


def limit(dims: int) -> int:
    """Integer components stop here, on either side: squared distances of whole vectors then fit in 63 bits."""
    return int(np.sqrt(2.0**60 / max(1, dims)) / 2)


def cell_width(book: np.ndarray) -> int:
    """The side of a cell: its diagonal is half of the median distance from an entry to the nearest other one."""
    if len(book) < 2:
        return 1
    x = book.astype(float)
    norm = (x * x).sum(1)
    gaps = np.maximum(norm[:, None] + norm[None] - 2 * x @ x.T, 0)
    np.fill_diagonal(gaps, np.inf)
    return max(1, int(np.sqrt(np.median(gaps.min(1)) / book.shape[1]) / 2))


class Cells:
    """One part's codebook and its memo of cells."""

    def __init__(self, book: np.ndarray):
        self.book, self.width = book, cell_width(book)
        self.memo: dict[bytes, np.ndarray] = {}

    def undominated(self, low: np.ndarray) -> list[np.ndarray]:
        """For each cell (its lowest corner) the entries, ascending, that can be nearest to a point in it."""
        out = []
        step = max(1, BLOCK // self.book.size)
        for at in range(0, len(low), step):
            below = low[at : at + step, None] - self.book[None]  # lowest corner less entry, by dimension
            above = below + (self.width - 1)
            least = np.maximum(0, np.maximum(below, -above))
            most = np.maximum(-below, above)
            least, most = (least * least).sum(2), (most * most).sum(2)
            out += [np.flatnonzero(x) for x in least <= most.min(1, keepdims=True)]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the nearest entry, the lowest on ties; its squared distance) of each row of x."""
        grid = np.ascontiguousarray(x // self.width)
        cells, of = np.unique(grid.view(np.dtype((np.void, grid.itemsize * grid.shape[1]))).ravel(), return_inverse=True)
        names = [c.tobytes() for c in cells]
        new = [k for k, c in enumerate(names) if c not in self.memo]
        if len(self.memo) + len(new) > CELLS:
            self.memo.clear()
            new = list(range(len(names)))
        corners = np.frombuffer(b"".join([names[k] for k in new]), grid.dtype).reshape(len(new), grid.shape[1]) * self.width
        found = dict(zip(new, self.undominated(corners)))
        self.memo.update((names[k], e) for k, e in list(found.items())[:CELLS])
        lists = [found[k] if k in found else self.memo[c] for k, c in enumerate(names)]
        entry, gap = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        step = max(1, BLOCK // self.book.size)
        for at in range(0, len(x), step):
            own = of[at : at + step]
            sizes = np.array([len(lists[k]) for k in own.tolist()])
            asked = np.concatenate([lists[k] for k in own.tolist()])
            rows = np.repeat(np.arange(len(own)), sizes)
            off = x[at : at + step][rows] - self.book[asked]
            far = (off * off).sum(1)
            starts = np.cumsum(sizes) - sizes
            gap[at : at + step] = least = np.minimum.reduceat(far, starts)
            entry[at : at + step] = np.minimum.reduceat(np.where(far == least[rows], asked, ENTRIES), starts)
        return entry, gap


def _vectors(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of equal length as integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    most = limit(dims)
    return np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64).reshape(-1, dims)


def _sums(books: list[np.ndarray], dims: int):
    cut = bounds(dims, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0), dims)
            for k, c in enumerate(cells):
                own = x[:, cut[k] : cut[k + 1]]
                entry, _ = c.nearest(own)
                np.add.at(total[k], entry, np.column_stack([np.ones(len(own), np.int64), own]))
        for k, t in enumerate(total):
            used = np.flatnonzero(t[:, 0])
            width = t.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used) * width, k), pa.int32()), pa.array(np.repeat(used, width), pa.int32()), pa.array(np.tile(np.arange(width), len(used)), pa.int32()), pa.array(t[used].ravel())], names=["part", "entry", "place", "s"])

    return run


def _coded(books: list[np.ndarray], dims: int):
    cut = bounds(dims, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0), dims)
            entries, gaps = zip(*[c.nearest(x[:, cut[k] : cut[k + 1]]) for k, c in enumerate(cells)])
            codes = [row.tobytes().hex() for row in np.column_stack(entries).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(codes, pa.string()), pa.array(sum(gaps))], names=["key", "label", "code", "error"])

    return run


def encode(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", *, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Kept are vectors that aren't null or empty, hold no null or non-finite component, and are as long as the kept vector with
    the smallest key.  Components become floor(1024 x), held within limit(), which vectors of a norm in the thousands
    don't meet.  The codebooks start from the ENTRIES smallest keys (null last, equal keys by their components), fewer
    where fewer rows are kept; repeated rows count as often as they are there.  label_error is the sum over equal
    labels, nulls together, at most the largest bigint.  An empty table gives no row.  A length that the parts don't
    divide gives parts that differ by one.  Keys and labels keep their types; other columns are left out.

    Each round is a map over all vectors whose tasks hand on at most a sum for each entry's component; the driver gets
    the summed codebooks, `parts` times ENTRIES entries, and the tasks get the next ones."""
    spark = df.sparkSession
    ship(spark)
    finite = F.forall(vector, lambda x: F.coalesce(x.cast("double") - x.cast("double") == 0, F.lit(False)))  # inf and nan less themselves aren't 0
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).select(F.col(vector).cast("array<double>").alias(f"{P}v"), F.col(key).alias("key"), F.col(label).alias("label"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    order = [F.col("key").asc_nulls_last(), f"{P}v"]
    one = rows.orderBy(*order).select(F.size(f"{P}v").alias("n")).first()
    dims = one["n"] if one else 0
    rows = rows.where(F.size(f"{P}v") == dims)
    first = rows.orderBy(*order).limit(ENTRIES).select(f"{P}v").collect()  # ENTRIES rows at most
    cut, most = bounds(dims, parts), limit(dims)
    start = np.clip(np.floor(np.array([r[0] for r in first], float).reshape(len(first), dims) * SCALE), -most, most).astype(np.int64)
    books = [start[:, a:z].copy() for a, z in zip(cut[:-1], cut[1:])]
    for _ in range(rounds if len(first) else 0):
        sums = rows.mapInArrow(_sums(books, dims), "part int, entry int, place int, s bigint").groupBy("part", "entry", "place").agg(F.sum("s").alias("s")).collect()
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for r in sums:
            total[r["part"]][r["entry"], r["place"]] = r["s"]
        for book, t in zip(books, total):
            used = t[:, 0] > 0
            book[used] = t[used, 1:] // t[used, :1]
    said = ",".join(str(x) for b in books for x in b.ravel().tolist())
    kinds = f"key {types['key']}, label {types['label']}, code string, error bigint"
    coded = stored(rows.mapInArrow(_coded(books, dims), kinds) if len(first) else spark.createDataFrame([], kinds), "vector-codes")
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("bigint").alias("label_error")).withColumnRenamed("label", f"{P}l")
    by_label = stored(by_label, "vector-labels")  # so that a label with a share of all rows can be split
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col(f"{P}l")), "left")
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))
