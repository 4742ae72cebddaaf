"""Near-duplicates by true shingle similarity: operator 7's fingerprints and min-hash bands propose, whole texts decide.

Two texts at a Jaccard similarity of 0.8 differ in some 10 of 64 SimHash bits (3 in one standard deviation), too
many for tables of a fingerprint's segments: these find near copies at the top of the range alone.  Bands of
min-hashes find the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import P, components, stored
from wattloom.llm.neardup import bit_votes, near_links, shingle_hashes, simhash

#: Words of a shingle, and the Jaccard similarity in percent from which two texts are linked.
WORDS, PERCENT = 5, 80
#: Bands and min-hashes in each: two sets at a similarity s share a band but for a chance of (1 - s^DEPTH)^BANDS,
#: 3 in a million at 0.8; at 0.3 it is 82 percent.
BANDS, DEPTH = 24, 4
#: Nodes, and shingles of all of them, in a block of a band's nodes about.
BLOCK, HEAVY = 256, 200_000
#: Equal bytes of two sketches (a byte of each min-hash) from which a pair's texts are compared in the last round:
#: at a similarity of 0.8 fewer come up three times in a million.
ALIKE = 58
#: Shingles that are hashed for all bands at once; bounds a worker's memory for texts of any length.
CHUNK = 1 << 14
_ODD = np.random.default_rng(13).integers(0, 1 << 63, BANDS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(hashes: list[int]) -> np.ndarray:
    """The distinct shingles, ascending."""
    return np.unique(np.fromiter(hashes, np.uint64, len(hashes)))


def bands(s: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of a set that isn't empty, equal in two sets if the band's min-hashes are, and the sketch."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), CHUNK):
        least = np.minimum(least, (s[k : k + CHUNK, None] * _ODD).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, DEPTH).T:
        key = (key ^ key >> np.uint64(32)) * _MIX + part
    return key, (least >> np.uint64(56)).astype(np.uint8).tobytes()


def shingle_keys(rows: DataFrame, text: str, row: str, words: int) -> DataFrame:
    """(row, s1, s2, n, fp, bands, sketch): a 128-bit name of the row's shingle set, its size, operator 7's
    fingerprint and the keys of its bands (none for a set without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            name, n, fp, keys = np.zeros((b.num_rows, 2), np.uint64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64), []
            sketches: list[bytes] = []
            for k, t in enumerate(b.column(1)):
                h = shingle_hashes(t.as_py(), words)
                s = shingle_set(h)
                raw = s.tobytes()
                name[k], n[k] = (xxh64_intdigest(raw, 1), xxh64_intdigest(raw, 2)), len(s)
                fp[k] = simhash(bit_votes(np.fromiter(h, np.uint64, len(h)), np.zeros(len(h), np.int64), 1), np.array([len(h)]))[0]
                key, sketch = bands(s) if len(s) else (np.zeros(0, np.uint64), b"")
                keys.append(key.view(np.int64))
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.view(np.int64)) for x in (name[:, 0].copy(), name[:, 1].copy(), n, fp)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=[row, "s1", "s2", "n", "fp", "bands", "sketch"])

    src = rows.select(row, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(f"{P}t"))
    return src.mapInArrow(run, f"`{row}` bigint, s1 bigint, s2 bigint, n bigint, fp bigint, bands array<bigint>, sketch binary")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None  # the rows come sorted by a, mostly
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (a, ta, tb) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3))):
                if a != last:
                    last, x = a, shingle_set(shingle_hashes(ta.as_py(), words))
                y = shingle_set(shingle_hashes(tb.as_py(), words))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both * 100 >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    d = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("body").alias("tb")), "b")
    d = d.join(texts.select(F.col("node").alias("a"), F.col("body").alias("ta")), "a").select("a", "b", "ta", "tb")
    return d.mapInArrow(run, "a bigint, b bigint")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that operator 7 links: each node with the first of its fingerprint, and the first
    nodes of two fingerprints within two bits."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    alike = nodes.select("fp", "node").join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = near_links(first.select("fp"))
    near = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("na")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("nb")), "b")
    return alike.unionByName(near.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")))


def near_copies(rows: DataFrame, text: str, row: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(row, root) for every row: equal root if a chain of texts joins the two, each at a Jaccard similarity of
    percent or more with the next, and only then.  `row` is a unique bigint; rows is read several times.  A null
    text is empty; texts without words are one set; repeated rows share a root.

    Equal sets are one node.  Nodes are proposed to one another by operator 7 and by shared bands, and every link
    is verified on the whole texts; a link at the similarity itself stays unproposed by a chance of 3 in a
    million.  First each node meets a leader of each of its bands only: groups of many near copies so are joined by links in
    proportion to their rows.  Then all pairs that share a band and are still in different
    components are met, block by block.  Only the texts of nodes that share a band are shuffled."""
    sets = stored(shingle_keys(rows, text, row, words), "shingle-keys")
    nodes = sets.groupBy("s1", "s2").agg(F.min(F.struct(row, "n", "fp", "bands", "sketch")).alias("x"))
    nodes = stored(nodes.select("s1", "s2", F.col(f"x.{row}").alias("node"), "x.n", "x.fp", "x.bands", "x.sketch"), "shingle-nodes")
    placed = nodes.select("node", "n", F.explode("bands").alias("token"))
    shared = placed.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token")
    live = stored(placed.join(shared, "token"), "shingle-members")
    alike = stored(_by_fingerprint(nodes).distinct(), "shingle-fingerprints")
    met = live.select("node").unionByName(alike.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = rows.select(F.col(row).alias("node"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")).join(met, "node")
    texts = stored(texts, "shingle-texts")
    first = live.groupBy("token").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).alias("f"))
    star = live.join(first, "token").where("node <> f.node").select(F.col("f.node").alias("a"), F.col("node").alias("b"), F.col("f.n").alias("na"), F.col("n").alias("nb"))
    star = star.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b").unionByName(alike).distinct()
    found = stored(_verified(star, texts, words, percent), "shingle-links")
    roots = components(found).select(F.col("node").alias("node2"), "root")
    live = stored(live.join(roots, F.col("node") == F.col("node2"), "left").select("token", "node", "n", F.coalesce("root", "node").alias("root")), "shingle-rooted")
    open_ = live.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    found = found.unionByName(stored(_apart(live.join(open_, "token"), nodes, texts, words, percent), "shingle-links"))
    named = nodes.join(components(found).withColumnRenamed("node", "node2"), F.col("node") == F.col("node2"), "left").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.coalesce("root", "node").alias("root"))
    return sets.select(row, "s1", "s2").join(named, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2"))).select(row, "root")


def _apart(live: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes of one band that are in different components so far.  A band's nodes are dealt over
    blocks, and a task compares two blocks: pairs whose sizes and sketches allow the similarity, in the first
    band that the two share, by their whole texts.  Texts so travel by node and block, not by pair."""
    cut = live.groupBy("token").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / HEAVY)).cast("int").alias("parts"))
    p, q = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    d = live.join(nodes.select("node", "bands", "sketch"), "node").join(texts, "node").join(cut, "token")
    dealt = d.select("token", "node", "n", "root", "bands", "sketch", "body", p.alias("p"), q.alias("q")).withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q")})

    def meet(k, t):
        node, n, root, part = (t.column(c).to_numpy() for c in ("node", "n", "root", "p"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        keys = np.array(t.column("bands").to_pylist(), np.int64).reshape(len(node), -1)
        band, body, sets, out = int(np.flatnonzero(keys[0] == k[0].as_py())[0]), t.column("body"), {}, []

        def of(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingle_set(shingle_hashes(body[x].as_py(), words))
            return sets[x]

        for s in range(0, len(node), 32):
            x = slice(s, s + 32)
            ok = (node[x, None] < node) & (root[x, None] != root) & (np.minimum(n[x, None], n) * 100 >= np.maximum(n[x, None], n) * percent)
            if k[1] != k[2]:
                ok &= part[x, None] != part
            a, b = np.nonzero(ok)
            a += s
            near = (sketch[a] == sketch[b]).sum(axis=1) >= ALIKE
            a, b = a[near], b[near]
            first = (keys[a] == keys[b]).argmax(axis=1) == band
            for u, v in zip(a[first].tolist(), b[first].tolist()):
                both = len(np.intersect1d(of(u), of(v), assume_unique=True))
                if both * 100 >= percent * (n[u] + n[v] - both):
                    out.append((node[u], node[v]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return dealt.groupBy("token", "i", "j").applyInArrow(meet, "a bigint, b bigint")
