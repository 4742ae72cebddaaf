"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 10)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import P, components, stored

#: Vectors in a tile, about: an eighth of them all, but within these bounds.  A pair of tiles is one unit of work,
#: and a vector is sent once for each tile that its own meets.
TILE, MOST_TILE = 2048, 16384
#: Distinct vectors that the rotation and the cells are fitted on at most: they steer the work, not its result.
SAMPLE = 4096
#: Leading dimensions that a tile's box is kept for, and those that are added up before each test.
BOX, STEP = 8, 16
#: Rows of one tile compared with the other tile at a time.
STRIP = 256


def fit(sample: np.ndarray, cells: int) -> tuple[np.ndarray, list]:
    """A rotation whose leading dimensions carry most of the sample's weight, and a tree of cuts by these:
    [dimension, value, below, above] or the number of a cell."""
    _, _, turn = np.linalg.svd(sample, full_matrices=True)
    turned = sample @ turn.T
    number = iter(range(1 << 30))

    def cut(x: np.ndarray, want: int):
        if want < 2 or len(x) < 8:
            return next(number)
        k = int(np.argmax(x[:, :BOX].var(0)))
        at = float(np.median(x[:, k]))
        low = x[:, k] < at
        if not low.any() or low.all():
            return next(number)
        return [k, at, cut(x[low], want // 2), cut(x[~low], want - want // 2)]

    return turn.T, cut(turned, cells)


def cell_of(tree, x: np.ndarray) -> np.ndarray:
    """The cell of each row of x."""
    out = np.zeros(len(x), np.int64)

    def walk(node, which: np.ndarray) -> None:
        if not isinstance(node, list):
            out[which] = node
            return
        low = x[which, node[0]] < node[1]
        walk(node[2], which[low])
        walk(node[3], which[~low])

    walk(tree, np.arange(len(x)))
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component under the links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def compare(x: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) whose unit vectors have cosine >= threshold.  Turned so that leading dimensions
    weigh most, products are added up STEP dimensions at a time; what the rest could still add is at most
    the product of the two suffix norms, and a pair that can't reach the threshold is dropped.  Pairs that
    remain are computed anew from the vectors as given."""
    tx, ty = x @ turn, y @ turn
    d = tx.shape[1]
    tails = lambda t: [np.sqrt(np.maximum((t[:, k:] ** 2).sum(1), 0)) for k in range(STEP, d, STEP)]
    rx, ry = tails(tx), tails(ty)
    for s in range(0, len(x), STRIP):
        part = tx[s : s + STRIP, :STEP] @ ty[:, :STEP].T
        live = None
        for k, at in enumerate(range(STEP, d, STEP)):
            if live is None:
                open_ = part + rx[k][s : s + STRIP, None] * ry[k][None, :] >= threshold - 1e-9
                share = np.count_nonzero(open_) / open_.size
                if share < 0.05:
                    live = np.nonzero(open_)
                    sums = part[live]
                else:
                    part += tx[s : s + STRIP, at : at + STEP] @ ty[:, at : at + STEP].T
                    continue
            else:
                keep = sums + rx[k][s + live[0]] * ry[k][live[1]] >= threshold - 1e-9
                live, sums = (live[0][keep], live[1][keep]), sums[keep]
            if not len(sums):
                break
            sums = sums + np.einsum("ij,ij->i", tx[s + live[0], at : at + STEP], ty[live[1], at : at + STEP])
        if live is None:
            live = np.nonzero(part >= threshold - 1e-9)
        i, j = live[0] + s, live[1]
        for q in range(0, len(i), 1 << 18):
            a, b = i[q : q + (1 << 18)], j[q : q + (1 << 18)]
            ok = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            yield a[ok], b[ok]


def _unit(raw: bytes, dim: int) -> np.ndarray:
    v = np.frombuffer(raw, np.float64).reshape(-1, dim)
    return v / np.sqrt((v * v).sum(1))[:, None]


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) for every row: the other rows with cosine >= threshold (double
    precision), the least key reachable over such links, and whether that is the row's own.

    Null, zero and non-finite vectors link with nothing, nor do vectors of different length; they keep their
    own key.  Equal vectors are one class and never paired.  Classes fall into cells of a tree over leading
    PCA dimensions, and cells into tiles; two tiles meet unless their boxes lie too far apart in these (vectors
    without leading dimensions: all tiles meet, and what is sent is the vectors times the tiles).  Components of
    any finite size are taken: vectors whose squares would leave the range are scaled first.  A task compares one pair of tiles and gives, for each class, its links and its least local
    neighbour: rows in proportion to the tiles, not to the links.  A null key takes part in links, but
    names no component."""
    spark = df.sparkSession
    nums = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.col(f"{P}v").isNotNull() & ~F.exists(F.col(f"{P}v"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(F.col(f"{P}v"), lambda v: v != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), nums.alias(f"{P}v")).withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.transform(F.col(f"{P}v"), lambda v: v + 0.0))).select("id", "v")
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.when((top < 1e-100) | (top > 1e100), F.transform("v", lambda x: x / top)).otherwise(F.col("v"))  # so that squares stay finite
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "least", "n", "v", scaled.alias("u"), F.size("v").alias("dim")), "vectors")
    sizes = {r["dim"]: r["m"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("m")).collect()}  # one row a vector length
    parts = []
    for dim, m in sizes.items():
        own = classes.where(F.col("dim") == dim)
        sample = np.array([r["u"] for r in own.orderBy(F.xxhash64(F.lit(3), "v"), "v").limit(SAMPLE).select("u").collect()])
        tile = min(MOST_TILE, max(TILE, m // 8))
        turn, tree = fit(sample / np.sqrt((sample * sample).sum(1))[:, None], max(1, m // tile))
        parts.append(_pairs(own, dim, turn, tree, threshold, tile))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
    else:
        found = spark.createDataFrame([], "node bigint, root bigint, links bigint")
    found = stored(found, "vector-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select(F.col("v").alias("v2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(named, F.col("v") == F.col("v2"), "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v2").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _pairs(own: DataFrame, dim: int, turn: np.ndarray, tree, threshold: float, tile: int) -> DataFrame:
    """(node, root, links) of each class that has a link, for each pair of tiles that it is found in."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(2).to_pylist(), np.float64).reshape(-1, dim)
            t = v / np.sqrt((v * v).sum(1))[:, None] @ turn
            raw = [x.tobytes() for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(cell_of(tree, t))], names=["node", "n", "raw", "cell"])

    placed = stored(own.select("node", "n", "u").mapInArrow(place, "node bigint, n bigint, raw binary, cell bigint"), "vector-cells")
    per = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("salts"))
    tiled = placed.join(F.broadcast(per), "cell")  # a row for each cell: an eighth of SAMPLE at most
    tiled = tiled.select("node", "n", "raw", (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("salts"))).alias("tile"))

    def pack(k, t):
        raw = b"".join(t.column("raw").to_pylist())
        turned = _unit(raw, dim) @ turn[:, :BOX]
        return pa.table({
            "tile": pa.array([k[0].as_py()], pa.int64()), "nodes": pa.array([t.column("node").to_numpy().astype(np.int64).tobytes()], pa.binary()), "ns": pa.array([t.column("n").to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "raw": pa.array([raw], pa.large_binary()).cast(pa.binary()), "low": pa.array([turned.min(0).tolist()], pa.list_(pa.float64())), "high": pa.array([turned.max(0).tolist()], pa.list_(pa.float64())),
        })

    tiles = stored(tiled.groupBy("tile").applyInArrow(pack, "tile bigint, nodes binary, ns binary, raw binary, low array<double>, high array<double>"), "vector-tiles")
    # boxes of tiles that can hold a link are at most this far apart; they share a bin of the leading dimension
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    width = max(reach, 0.01)
    bins = lambda lo, hi: F.sequence(F.floor(lo / width).cast("int"), F.floor(hi / width).cast("int"))
    boxes = tiles.select("tile", "low", "high")
    a = boxes.select(F.col("tile").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(bins(F.col("low")[0], F.col("high")[0])).alias("bin"))
    b = boxes.select(F.col("tile").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(bins(F.col("low")[0] - reach, F.col("high")[0] + reach)).alias("bin"))
    away = F.zip_with(F.zip_with("la", "hb", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.zip_with("lb", "ha", lambda x, y: F.greatest(x - y, F.lit(0.0))), lambda x, y: F.greatest(x, y))
    near = F.aggregate(away, F.lit(0.0), lambda s, x: s + x * x) <= reach * reach
    pairs = a.join(b, "bin").where((F.col("a") <= F.col("b")) & near).select("a", "b").distinct()
    sent = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile")).join(tiles.select("tile", "nodes", "ns", "raw"), "tile")

    def meet(k, t):
        held = {r["tile"]: r for r in t.to_pylist()}
        a, b = held[k[0].as_py()], held[k[1].as_py()]
        load = lambda r: (np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["ns"], np.int64), _unit(r["raw"], dim))
        (na, ca, xa), (nb, cb, xb) = load(a), load(b)
        same = a["tile"] == b["tile"]
        nodes = na if same else np.concatenate([na, nb])
        shift = 0 if same else len(na)
        order = np.argsort(nodes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for i, j in compare(xa, xb, turn, threshold):
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, cb[j])
            np.add.at(links, j + shift, ca[i])
            root = forest(len(nodes), np.concatenate([rank[i], np.arange(len(nodes))]), np.concatenate([rank[j + shift], root]))
        own = np.nonzero(links)[0]
        return pa.table({"node": nodes[own], "root": nodes[order][root[rank[own]]], "links": links[own]})

    return sent.groupBy("a", "b").applyInArrow(meet, "node bigint, root bigint, links bigint")
