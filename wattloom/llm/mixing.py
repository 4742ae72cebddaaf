"""Mixing overlapping sources to target weights by min-cost flow (operator 8)."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import P, WORD, buckets_for, dense_rank_by_hash, stored

#: A document is used at most this often.
EPOCHS = 3


def targets_by_weight(sizes: dict[str | None, int], weights: list[int], most: int = EPOCHS) -> dict[str | None, float]:
    """Targets that share 100 % of all sizes: sources by code point, null last, get the weights in turn; a
    target stops at `most` times its source's size, and what is over is shared again by weight."""
    order = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in over]
    return out


@dataclass
class _Arc:
    to: int
    cap: int
    cost: int
    back: int


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, epochs: int = EPOCHS) -> list[dict]:
    """For each pattern (its sources, its words) the words that it gives to each source.  The e-th use of a
    pattern's words costs e * e (convex, so fresh words go first); a source takes its quota at most.  The
    largest flow, and the cheapest of those, by shortest augmenting paths with potentials.  The graph has
    patterns + sources nodes: it is the aggregated mixture, never documents."""
    names = list(quotas)
    n_p, n_s = len(patterns), len(names)
    src, sink = n_p + n_s, n_p + n_s + 1
    graph: list[list[_Arc]] = [[] for _ in range(n_p + n_s + 2)]

    def arc(a: int, b: int, cap: int, cost: int) -> None:
        graph[a].append(_Arc(b, cap, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0, -cost, len(graph[a]) - 1))

    at = {s: n_p + k for k, s in enumerate(names)}
    for k, (members, words) in enumerate(patterns):
        for e in range(epochs):
            arc(src, k, words, e * e)
        for s in members:
            if s in at:
                arc(k, at[s], epochs * words, 0)
    for s in names:
        arc(at[s], sink, quotas[s], 0)
    high = [0] * len(graph)
    while True:
        dist: list[float] = [float("inf")] * len(graph)
        dist[src] = 0
        came: list[tuple[int, int] | None] = [None] * len(graph)
        heap = [(0, src)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, x in enumerate(graph[u]):
                if x.cap > 0 and (nd := d + x.cost + high[u] - high[x.to]) < dist[x.to]:
                    dist[x.to], came[x.to] = nd, (u, k)
                    heapq.heappush(heap, (nd, x.to))
        if came[sink] is None:
            break
        high = [h + (int(d) if d < float("inf") else 0) for h, d in zip(high, dist)]
        push, v = None, sink
        while v != src:
            u, k = came[v]
            push = graph[u][k].cap if push is None else min(push, graph[u][k].cap)
            v = u
        v = sink
        while v != src:
            u, k = came[v]
            graph[u][k].cap -= push
            graph[v][graph[u][k].back].cap += push
            v = u
    return [{names[x.to - n_p]: epochs * words - x.cap for x in graph[k] if n_p <= x.to < n_p + n_s and epochs * words > x.cap} for k, (_, words) in enumerate(patterns)]


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(df: DataFrame, members: str, size: str, targets: dict, *, seed: int = 23, key: list[str], epochs: int = EPOCHS, most_patterns: int = 100_000) -> DataFrame:
    """Adds taken (bigint: size times its uses), uses (int, 0 to epochs) and credit (the source that each
    use counts for) to every row of df.  `members` is an array column with the sources that hold the row,
    `targets` the words wanted by source, `key` the columns that seed the order.

    Rows are summed by membership pattern; min_cost_flow routes the patterns' words to the quotas; each
    pattern then gives whole passes over its rows, and for the rest rows in seeded order while they fit; the
    same is repeated over the other rows that aren't longer than what is still open, until none is.  Ranks and
    running words come by hash range, so that a pattern with a third of all rows is no single task.  A null or empty membership takes nothing; rows of size 0
    are used as often as their pattern's passes say.  The driver holds one row for each pattern."""
    spark: SparkSession = df.sparkSession
    cols = [c for c in df.columns if c not in ("taken", "uses", "credit")]
    d = df.select(*cols, F.to_json(F.array_sort(F.array_distinct(F.col(members)))).alias(f"{P}p"), F.xxhash64(F.lit(seed), *key, F.col(size)).alias(f"{P}h"))
    per = d.groupBy(f"{P}p").agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("words"), F.count(F.lit(1)).alias("n"), F.first(members).alias("members")).limit(most_patterns + 1).collect()
    if len(per) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns; merge rare ones before mixing")
    quotas = {s: round(t) for s, t in targets.items()}
    flows = min_cost_flow([(tuple(r["members"] or ()), int(r["words"])) for r in per], quotas, epochs)
    plan = []
    for r, flow in zip(per, flows):
        give = sum(flow.values())
        passes, rest = divmod(give, r["words"]) if r["words"] else (0, 0)
        ends, at = [], 0
        for s, f in sorted(flow.items(), key=lambda x: (x[0] is None, x[0] or "")):
            at += f
            ends.append((s, at))
        plan.append((r[f"{P}p"], int(passes), int(rest), int(r["words"]), ends))
    kind = f"{P}p2 string, {P}passes int, {P}rest bigint, {P}words bigint, {P}ends array<struct<s:string,at:bigint>>"
    plan_df = F.broadcast(spark.createDataFrame(plan, kind).coalesce(1)) if plan else spark.createDataFrame([], kind)  # most_patterns rows at most
    d = dense_rank_by_hash(d, f"{P}p", f"{P}h", f"{P}k", weight=size, buckets=buckets_for(sum(r["n"] for r in per)), ties=key)
    d = stored(d.join(plan_df, F.col(f"{P}p").eqNullSafe(F.col(f"{P}p2")), "left"), "mixing")
    own = F.coalesce(F.col(size), F.lit(0))
    fits = F.col(f"{P}k_sum") + own <= F.col(f"{P}rest")
    used = {r[f"{P}p"]: r["f"] for r in d.groupBy(f"{P}p").agg(F.max(F.when(fits, F.col(f"{P}k_sum") + own)).alias("f")).collect()}
    gap = {p: rest - (used.get(p) or 0) for p, _, rest, _, _ in plan if rest}
    filled = None
    left = d.where(~fits & (own > 0)).select(F.col(f"{P}p").alias("p"), F.col(f"{P}k").alias("k"), F.col(f"{P}h").alias("h"), own.alias("w"))
    while open_ := [(p, g) for p, g in gap.items() if g > 0]:
        now = F.broadcast(spark.createDataFrame(open_, "p string, g bigint").coalesce(1))
        left = stored(left.select("p", "k", "h", "w").join(now, "p").where("w <= g"), "mixing-left")
        n = left.count()
        if not n:
            break
        left = stored(dense_rank_by_hash(left, "p", "h", "at", weight="w", buckets=buckets_for(n), ties=["k"]), "mixing-ranked")
        more = left.where("at_sum + w <= g").select("p", "k", "w")
        for r in more.groupBy("p").agg(F.sum("w").alias("w")).collect():
            gap[r["p"]] -= r["w"]
        filled = more if filled is None else filled.unionByName(more)
        left = left.where("at_sum + w > g")
    if filled is not None:
        d = stored(d.join(filled.select(F.col("p").alias(f"{P}p6"), F.col("k").alias(f"{P}k6")), (F.col(f"{P}p") == F.col(f"{P}p6")) & (F.col(f"{P}k") == F.col(f"{P}k6")), "left"), "mixing-filled")
    else:
        d = d.withColumn(f"{P}k6", F.lit(None).cast("bigint"))
    marks: list[tuple] = []
    marked = lambda m: d.join(F.broadcast(spark.createDataFrame(m, f"{P}p4 string, {P}at bigint, {P}mark int").coalesce(1)), F.col(f"{P}p").eqNullSafe(F.col(f"{P}p4")) & (F.col(f"{P}k") == F.col(f"{P}at")), "left")
    # what is still open: one row more in exchange for one that is smaller by about the gap
    state = marked(marks)
    taken_once = ((F.coalesce(fits, F.lit(False)) | F.col(f"{P}k6").isNotNull()) & F.coalesce(F.col(f"{P}mark") != -1, F.lit(True)) | F.coalesce(F.col(f"{P}mark") == 1, F.lit(False))) & (F.col(f"{P}rest") > 0)
    gap = {p: g for p, g in gap.items() if g > 0}
    if gap:
        small = spark.createDataFrame(list(gap.items()), f"{P}p3 string, {P}gap bigint").coalesce(1)
        extra = {r[f"{P}p"]: r["b"] for r in state.where(~taken_once).join(F.broadcast(small), F.col(f"{P}p").eqNullSafe(F.col(f"{P}p3"))).where(own > F.col(f"{P}gap")).groupBy(f"{P}p").agg(F.min(F.struct(own.alias("w"), F.col(f"{P}k").alias("k"))).alias("b")).collect()}
        want = [(p, x["w"] - gap[p]) for p, x in extra.items()]
        out_of = F.broadcast(spark.createDataFrame(want, f"{P}p3 string, {P}want bigint").coalesce(1))
        off = F.struct(F.abs(own - F.col(f"{P}want")).alias("off"), F.col(f"{P}k").alias("k"))
        back = state.where(taken_once).join(out_of, F.col(f"{P}p").eqNullSafe(F.col(f"{P}p3"))).groupBy(f"{P}p").agg(F.min(off).alias("b")).collect()
        for r in back:
            p = r[f"{P}p"]
            if r["b"]["off"] < gap[p]:
                marks += [(p, r["b"]["k"], -1), (p, extra[p]["k"], 1)]
    d = marked(marks)
    once = taken_once
    uses = (F.coalesce(f"{P}passes", F.lit(0)) + once.cast("int")).cast("int")
    middle = lambda e: e * F.col(f"{P}words") + F.col(f"{P}k_sum") + F.expr(f"`{size}` div 2")
    credit = F.when(F.col("uses") > 0, F.transform(F.sequence(F.lit(0), F.col("uses") - 1), lambda e: F.coalesce(F.get(F.filter(f"{P}ends", lambda x: x["at"] > middle(e)), F.lit(0)), F.try_element_at(f"{P}ends", F.lit(-1)))["s"])).otherwise(F.array().cast("array<string>"))
    out = d.withColumn("uses", uses).withColumn("credit", credit).withColumn("taken", (own * F.col("uses")).cast("long"))
    return out.select(*cols, "taken", "uses", "credit")
