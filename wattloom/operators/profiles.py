"""Hourly profiles: k-means over normalised days, and the split of daily totals into hours."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.calendar import HOLIDAY_NAMES, SPECIAL_SPLIT, holiday_flags, mmdd
from wattloom.functions.expressions import array_sum, hours_array, mean_profile, normalised, scaled, wide
from wattloom.schema import HOURS
from wattloom.session import scratch, stored

#: Clusters, days of history, tolerance of the sum check.
CLUSTERS_NORMAL, CLUSTERS_SPECIAL, HISTORY_DAYS, SUM_TOLERANCE = 35, 15, 90, 0.01
#: Shares of the hours where no profile is fitted (they sum to 0.997 and are normalised).
FALLBACK = [0.038, 0.036, 0.034, 0.035, 0.037, 0.040, 0.042, 0.044, 0.045, 0.044, 0.043, 0.042, 0.041, 0.040, 0.041, 0.042, 0.043, 0.045, 0.047, 0.048, 0.046, 0.044, 0.041, 0.039]


def fallback_profile() -> Column:
    return F.array(*[F.lit(x / sum(FALLBACK)) for x in FALLBACK])


def normal_days(df: DataFrame, holidays: DataFrame, keys: list[str], days: int = HISTORY_DAYS, asof: str | None = None) -> DataFrame:
    """(keys, FECHA, profile): complete days without holidays, of the last `days` up to each key's last day
    (or up to asof), as shares of their sum; days that sum to 0 go."""
    d = df.where(F.col("FECHA") <= F.to_date(F.lit(asof))) if asof else df
    last = d.groupBy(*keys).agg(F.max("FECHA").alias("__end"))
    d = d.join(last, keys).where(F.col("FECHA") >= F.date_sub("__end", days)).drop("__end").dropna(subset=HOURS)
    h = holidays.select(*keys, "FECHA").distinct()
    return _shares(d.join(h, [*keys, "FECHA"], "left_anti"), keys)


def _shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, FECHA, profile): each date's mean hours as shares of their sum.  The test for a sum of 0 comes after
    the aggregate on purpose: a filter over two dozen computed hours, pushed below the projection that computes
    them, makes the optimizer derive a constraint for every combination of their aliases."""
    mean = df.withColumn("__a", hours_array()).groupBy(*keys, "FECHA").agg(mean_profile("__a").alias("__m")).withColumn("__t", array_sum(F.col("__m"))).where("__t <> 0")
    return mean.select(*keys, "FECHA", normalised(F.col("__m"), F.col("__t")).alias("profile"))


def special_days(df: DataFrame, holidays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, FECHA, profile): the mean hours of each holiday and of 24 December and 2 January, as shares."""
    return _shares(holiday_flags(df, holidays, keys).where(F.col("es_festivo") | mmdd("FECHA").isin(*SPECIAL_SPLIT)), keys)


def kmeans_helper(n_keys: int, clusters: int, seed: int, starts: int) -> Callable:
    """For one key's days: assigns each to a cluster.  A numpy helper over some ninety rows of 24 values; the
    nearest centroid wins, the first on ties; the best of several seeded starts is kept."""

    def fit(days):
        import numpy as np

        x = np.stack(days["profile"].to_numpy()).astype(float)
        order = np.argsort(days["FECHA"].to_numpy(), kind="stable")
        x = x[order]
        k = min(clusters, len(np.unique(x, axis=0)))
        rng, best = np.random.default_rng(seed), None
        for _ in range(starts):
            c = x[[int(rng.integers(len(x)))]]
            while len(c) < k:  # the next centre in proportion to the squared distance to the nearest so far
                gap = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
                c = np.vstack([c, x[int(rng.choice(len(x), p=gap / gap.sum()))] if gap.sum() > 0 else x[int(rng.integers(len(x)))]])
            for _ in range(100):
                near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                new = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
                if np.allclose(new, c, atol=1e-12):
                    break
                c = new
            dist = ((x[:, None] - c[None]) ** 2).sum(2)
            if best is None or dist.min(1).sum() < best[0] - 1e-15:
                best = (dist.min(1).sum(), dist.argmin(1))
        out = days[[*days.columns[:n_keys], "FECHA", "profile"]].iloc[order].copy()
        out["cluster"] = best[1].astype("int32")
        return out

    return fit


def cluster_days(days: DataFrame, keys: list[str], clusters: int, seed: int = 42, starts: int = 20) -> DataFrame:
    """(keys, FECHA, profile, cluster), fitted for each key on its own; groups are bounded by the days of history."""
    fields = ", ".join(f"`{k}` {days.schema[k].dataType.simpleString()}" for k in keys)
    src = days.select(*keys, "FECHA", "profile")
    return src.groupBy(*keys).applyInPandas(kmeans_helper(len(keys), clusters, seed, starts), f"{fields}, FECHA date, profile array<double>, cluster int")


def cluster_days_pooled(days: DataFrame, clusters: int, seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """The same over all keys at once with Spark ML; of several seeds the least training cost is kept."""
    v = days.withColumn("__v", array_to_vector("profile")).cache()
    models = [KMeans(k=clusters, seed=s, featuresCol="__v", predictionCol="cluster").fit(v) for s in seeds]
    return min(models, key=lambda m: m.summary.trainingCost).transform(v).drop("__v")


def _nearest(days: DataFrame, centres: DataFrame, by: list[str]) -> DataFrame:
    """days with __c and __d: the number of the nearest centre of its group (the lowest on ties) and the squared distance to
    it.  A group's centres travel as one array, so a day meets them in one equi-join and no pairs are made."""
    packed = centres.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__c", "__p"))).alias("__all"))
    gap = lambda c: F.aggregate(F.zip_with(F.col("profile"), c["__p"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("__all", lambda c: F.struct(gap(c).alias("d"), c["__c"].alias("c"))))
    return days.join(packed, by).withColumn("__b", best).select(*by, "FECHA", "profile", F.col("__b.c").alias("__c"), F.col("__b.d").alias("__d"))


def lloyd_clusters(days: DataFrame, keys: list[str], clusters: int, starts: int = 4, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """(keys, FECHA, profile, cluster): k-means of every key at once, as joins and aggregates, without a random number.

    Start s of S takes as centres the days at ranks floor((2 S j + 2 s + 1) n / (2 S k)) of a key's n days by date, j from 0
    to k - 1, k the lesser of clusters and n.  A round sends every day to the nearest centre of its key and start and moves
    each centre to the mean of its days; one without days stays.  All keys and starts move together, until none moves by more
    than the tolerance or after `rounds`.  The start of the least squared distance in all (to 12 places, then the first) is
    kept, and a key's clusters are numbered from 0 by their earliest day.  Only the largest move comes to the driver.
    Days without a profile go, as do columns other than those named; of equal dates of a key one is kept, since profiles are
    one a date; a null key is no key and goes; an empty table stays empty.  What a task holds of a key is `clusters` centres;
    days of a key meet in one task only to be ranked by date."""
    by = [*keys, "__s"]
    d = days.select(*keys, "FECHA", "profile").where(F.col("profile").isNotNull()).dropna(subset=keys).dropDuplicates([*keys, "FECHA"])
    d = stored(d.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("FECHA")) - 1), "days")
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__k", F.least(F.lit(clusters), "__n"))
    grid = n.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).withColumn("__c", F.explode(F.sequence(F.lit(0), (F.col("__k") - 1).cast("int"))))
    rank = F.expr(f"((2 * {starts} * __c + 2 * __s + 1) * __n) div (2 * {starts} * __k)").cast("int")
    centres = stored(grid.withColumn("__i", rank).join(d, [*keys, "__i"]).select(*by, "__c", F.col("profile").alias("__p")), "centres")
    # the days are few and their distances many: as many files, and so tasks, as a shuffle has, whatever their bytes
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide_days = stored(d.drop("__i").withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).repartition(tasks, *by, "FECHA"), "days")
    for _ in range(rounds):
        means = _nearest(wide_days, centres, by).groupBy(*by, "__c").agg(mean_profile("profile").alias("__m"))
        moved = centres.join(means, [*by, "__c"], "left").withColumn("__m", F.coalesce("__m", "__p"))
        step = F.array_max(F.zip_with("__p", "__m", lambda x, y: F.abs(x - y)))
        new = stored(moved.select(*by, "__c", F.col("__m").alias("__p"), step.alias("__step")), "centres")
        centres, most = new.drop("__step"), new.agg(F.max("__step")).first()[0]
        if most is None or most <= tolerance:
            break
    near = stored(_nearest(wide_days, centres, by), "nearest")
    cost = near.groupBy(*by).agg(F.round(F.sum("__d"), 12).alias("__cost")).groupBy(*keys).agg(F.min_by("__s", F.struct("__cost", "__s")).alias("__s"))
    mine = near.join(cost, by).select(*keys, "FECHA", "profile", "__c")
    first = mine.groupBy(*keys, "__c").agg(F.min("FECHA").alias("__first"))
    number = first.select(*keys, "__c", (F.row_number().over(Window.partitionBy(*keys).orderBy("__first")) - 1).cast("int").alias("cluster"))
    return mine.join(number, [*keys, "__c"]).select(*keys, "FECHA", "profile", "cluster")


def cluster_profiles(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, profile): the mean of each cluster, made to sum to 1."""
    m = clustered.groupBy(*keys, "cluster").agg(mean_profile("profile").alias("__m"), F.count(F.lit(1)).alias("days"))
    return m.select(*keys, "cluster", normalised(F.col("__m")).alias("profile"), "days")


def cluster_by(clustered: DataFrame, keys: list[str], what: Column, name: str) -> DataFrame:
    """The most frequent cluster of each weekday or month-day; the lowest on ties."""
    return clustered.groupBy(*keys, what.alias(name)).agg(F.mode(F.col("cluster"), True).alias("cluster"))


def average_holiday_profile(special: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, profile): the mean of the special days of each key's latest year, made to sum to 1."""
    y = special.withColumn("__y", F.year("FECHA"))
    last = y.groupBy(*keys).agg(F.max("__y").alias("__last"))
    m = y.join(last, keys).where("__y = __last").groupBy(*keys).agg(mean_profile("profile").alias("__m"))
    return m.select(*keys, normalised(F.col("__m")).alias("profile"))


class HourlyModel:
    """Five small tables for each key: cluster profiles and the cluster of a weekday, cluster profiles and the
    cluster of a month-day, and the average holiday.  All are joined by key; AQE broadcasts them where small."""

    def __init__(self, normal: DataFrame, by_weekday: DataFrame, special: DataFrame, by_mmdd: DataFrame, average: DataFrame, ends: DataFrame):
        self.normal, self.by_weekday, self.special, self.by_mmdd, self.average, self.ends = normal, by_weekday, special, by_mmdd, average, ends


def fit_hourly(df: DataFrame, holidays: DataFrame, keys: list[str], *, seed: int = 42, asof: str | None = None, clusters: tuple[int, int] = (CLUSTERS_NORMAL, CLUSTERS_SPECIAL), lloyd: bool = False) -> HourlyModel:
    """The tables that a split needs, of all keys; with lloyd the clusters come from lloyd_clusters, which has no seed."""
    fit = lloyd_clusters if lloyd else lambda days, by, k: cluster_days(days, by, k, seed)
    scratch(df.sparkSession)  # named before the two fits, which run side by side, ask for it
    with ThreadPoolExecutor(2) as pool:
        a = pool.submit(lambda: stored(fit(normal_days(df, holidays, keys, asof=asof), keys, clusters[0]), "normal"))
        b = pool.submit(lambda: stored(fit(special_days(df, holidays, keys), keys, clusters[1]), "special"))
        normal, special = a.result(), b.result()
    return HourlyModel(
        cluster_profiles(normal, keys), cluster_by(normal, keys, F.weekday("FECHA"), "dow"), cluster_profiles(special, keys), cluster_by(special, keys, mmdd("FECHA"), "mmdd"),
        average_holiday_profile(special, keys), df.groupBy(*keys).agg(F.max("FECHA").alias("trained_to")),
    )


def split_days(totals: DataFrame, model: HourlyModel, holidays: DataFrame, keys: list[str], total: str = "TOTAL") -> DataFrame:
    """Daily totals to 24 hours, all at once: holidays, 24 December and 2 January by the special profiles (the
    average holiday where their month-day has none, cluster -1), other days by their weekday's cluster (0
    where it has none); days without any profile by the fixed one.  Adds method, cluster_id, profile, hours,
    the sum check and P1..P24."""
    d = holiday_flags(totals, holidays, keys).withColumns({"__special": F.col("es_festivo") | mmdd("FECHA").isin(*SPECIAL_SPLIT), "dow": F.weekday("FECHA"), "mmdd": mmdd("FECHA")})
    d = d.join(model.by_weekday.withColumnRenamed("cluster", "__n"), [*keys, "dow"], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    d = d.join(model.normal.select(*keys, F.col("cluster").alias("__n"), F.col("profile").alias("__pn")), [*keys, "__n"], "left")
    d = d.join(model.by_mmdd.withColumnRenamed("cluster", "__s"), [*keys, "mmdd"], "left")
    d = d.join(model.special.select(*keys, F.col("cluster").alias("__s"), F.col("profile").alias("__ps")), [*keys, "__s"], "left")
    d = d.join(model.average.withColumnRenamed("profile", "__pa"), keys, "left")
    has = F.when(F.col("__special"), F.coalesce("__ps", "__pa")).otherwise(F.col("__pn"))
    d = d.withColumns({"method": F.when(F.col("__special"), "special").otherwise("normal"), "cluster_id": F.when(F.col("__special"), F.coalesce("__s", F.lit(-1))).otherwise(F.col("__n")), "profile": F.coalesce(has, fallback_profile())})
    d = d.withColumn("method", F.when(has.isNull(), "fallback").otherwise(F.col("method"))).withColumn("hours", scaled(F.col("profile"), F.col(total)))
    d = check_sums(d, "hours", total)
    return d.drop("__special", "dow", "mmdd", "__n", "__pn", "__s", "__ps", "__pa", "festivo_nombre", *[c for c in HOURS if c in totals.columns]).select("*", *wide(F.col("hours")))


def check_sums(df: DataFrame, hours: str = "hours", total: str = "TOTAL") -> DataFrame:
    """Sum of the hours, its difference from the total, plain and in percent, and whether it is below 0.01."""
    s = array_sum(F.col(hours))
    gap = F.abs(s - F.col(total))
    return df.withColumns({"sum_hours": s, "sum_diff": gap, "sum_error_pct": F.try_divide(gap * 100, F.abs(F.col(total))), "sum_valid": gap < SUM_TOLERANCE})


def relevance(days: DataFrame, ends: DataFrame, keys: list[str], back: int = HISTORY_DAYS, ahead: int = 30, strict: bool = False) -> DataFrame:
    """Whether a key's fitted profiles still hold for a day: from `back` days before the end of training to
    `ahead` after it (none, if strict)."""
    d = days.join(ends, keys, "left")
    return d.withColumn("relevant", F.coalesce(F.col("FECHA").between(F.date_sub("trained_to", back), F.date_add("trained_to", 0 if strict else ahead)), F.lit(False)))


def refit_needed(days: DataFrame, ends: DataFrame, history: DataFrame, keys: list[str], last_refit: DataFrame | None = None, least_rows: int = 30, pause: int = 30) -> DataFrame:
    """For each key's earliest day that isn't covered: whether to refit on the history up to it (enough rows,
    and no refit within the pause before)."""
    asked = relevance(days, ends, keys).where("not relevant").groupBy(*keys).agg(F.min("FECHA").alias("asof"))
    rows = asked.join(history.select(*keys, F.col("FECHA").alias("__d")), keys, "left").groupBy(*keys, "asof").agg(F.sum((F.col("__d") <= F.col("asof")).cast("int")).alias("rows"))
    if last_refit is None:
        return rows.withColumn("refit", F.coalesce(F.col("rows") >= least_rows, F.lit(False)))
    d = rows.join(last_refit, keys, "left")
    return d.withColumn("refit", F.coalesce(F.col("rows") >= least_rows, F.lit(False)) & F.coalesce(F.abs(F.datediff("asof", "refitted_at")) > pause, F.lit(True)))


def refit_chain(days: DataFrame, ends: DataFrame, history: DataFrame, keys: list[str], back: int = HISTORY_DAYS, ahead: int = 30, pause: int = 30, least_rows: int = 30) -> DataFrame:
    """(keys, FECHA, rows, trained_to, refit): every date at which a refit is tried when a key's days are split in order.

    Tried is a date that the profiles in force don't reach (`back` days before the end of their training to `ahead` after
    it), unless the try before is within `pause` days.  A try with least_rows rows of history up to its date succeeds and
    moves the end of training to the last of them; one with fewer leaves it, but starts the pause too.  Each try depends on
    those before, so a key's days are folded in order, in one row a key (a date and a count a day); keys run in parallel.
    Null dates and dates that repeat are passed over; a key without `ends` is untrained, and its first day is tried."""
    h = history.where(F.col("FECHA").isNotNull()).groupBy(*keys, "FECHA").agg(F.count(F.lit(1)).alias("__n"))
    both = h.withColumn("__t", F.lit(False)).unionByName(days.where(F.col("FECHA").isNotNull()).select(*keys, "FECHA").distinct().select("*", F.lit(0).cast("bigint").alias("__n"), F.lit(True).alias("__t")))
    w = Window.partitionBy(*keys).orderBy("FECHA", "__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumns({"rows": F.coalesce(F.sum("__n").over(w), F.lit(0)), "end": F.max(F.when(~F.col("__t"), F.col("FECHA"))).over(w)}).where("__t")
    one = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("FECHA", "rows", "end"))).alias("__d")).join(ends.select(*keys, F.col("trained_to").alias("__e")), keys, "left")
    tries = "array<struct<FECHA:date,rows:bigint,trained_to:date,refit:boolean>>"
    start = F.struct(F.col("__e").cast("date").alias("to"), F.lit(None).cast("date").alias("tried"), F.array().cast(tries).alias("all"))

    def step(s: Column, d: Column) -> Column:
        paused = F.coalesce(F.datediff(d["FECHA"], s["tried"]) <= pause, F.lit(False))
        reached = F.coalesce(d["FECHA"].between(F.date_sub(s["to"], back), F.date_add(s["to"], ahead)), F.lit(False))
        good = d["rows"] >= least_rows
        to = F.when(good, d["end"]).otherwise(s["to"])
        here = F.struct(d["FECHA"].alias("FECHA"), d["rows"].alias("rows"), to.alias("trained_to"), good.alias("refit"))
        return F.when(paused | reached, s).otherwise(F.struct(to.alias("to"), d["FECHA"].alias("tried"), F.concat(s["all"], F.array(here)).cast(tries).alias("all")))

    return one.select(*keys, F.explode(F.aggregate("__d", start, step)["all"]).alias("x")).select(*keys, "x.*")


def refit_days(history: DataFrame, holidays: DataFrame, chain: DataFrame, keys: list[str], days: int = HISTORY_DAYS) -> DataFrame:
    """(keys, asof, FECHA, profile): the days that each successful refit learns from.  A refit has days + 1 dates, which meet
    the history by equality; no history is read once a refit."""
    wanted = chain.where("refit").select(*keys, F.col("FECHA").alias("asof"), F.explode(F.sequence(F.date_sub("trained_to", days), F.col("trained_to"))).alias("FECHA"))
    d = history.dropna(subset=HOURS).join(wanted, [*keys, "FECHA"])
    return _shares(d.join(holidays.select(*keys, "FECHA").distinct(), [*keys, "FECHA"], "left_anti"), [*keys, "asof"])


def in_force(days: DataFrame, chain: DataFrame, keys: list[str]) -> DataFrame:
    """days with asof: the date of the last successful refit up to each, null before the first."""
    ok = chain.where("refit").select(*keys, "FECHA", F.col("FECHA").alias("__a"))
    w = Window.partitionBy(*keys).orderBy("FECHA", F.col("__a").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = ok.unionByName(days.select(*keys, "FECHA").distinct().withColumn("__a", F.lit(None).cast("date")))
    found = both.withColumn("asof", F.last("__a", ignorenulls=True).over(w)).where("__a is null").select(*keys, "FECHA", "asof")
    return days.join(found, [*keys, "FECHA"], "left")


def split_by_refits(totals: DataFrame, history: DataFrame, holidays: DataFrame, chain: DataFrame, keys: list[str], seed: int = 42, total: str = "TOTAL") -> DataFrame:
    """Normal days to hours, each by the profiles in force on it: (keys, FECHA, asof, cluster_id, hours and their check).
    Every refit of every key is fitted in one job; days before the first one take the fixed profile."""
    by = [*keys, "asof"]
    fitted = stored(cluster_days(refit_days(history, holidays, chain, keys), by, CLUSTERS_NORMAL, seed), "refits")
    d = in_force(totals.select(*keys, "FECHA", total), chain, keys).withColumn("dow", F.weekday("FECHA"))
    d = d.join(cluster_by(fitted, by, F.weekday("FECHA"), "dow"), [*by, "dow"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))
    d = d.join(cluster_profiles(fitted, by).drop("days"), [*by, "cluster"], "left")
    d = d.withColumns({"cluster_id": F.when(F.col("profile").isNotNull(), F.col("cluster")), "hours": scaled(F.coalesce("profile", fallback_profile()), F.col(total))})
    return check_sums(d, "hours", total).drop("dow", "cluster", "profile").select("*", *wide(F.col("hours")))


def special_day_list(model: HourlyModel, keys: list[str]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in HOLIDAY_NAMES.items() for x in kv])
    return model.by_mmdd.select(*keys, "mmdd", "cluster", F.coalesce(F.try_element_at(names, F.col("mmdd")), F.lit("Festivo")).alias("nombre")).orderBy(*keys, "mmdd")


def pca_view(days: DataFrame, clusters: int = 4, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Standardised hours (population std) on two principal components with k-means labels; the signs of
    components are free.  Also the share of variance that each component explains."""
    v = days.dropna(subset=HOURS).withColumn("__h", array_to_vector(hours_array()))
    n = v.count()
    s = StandardScaler(inputCol="__h", outputCol="__z", withMean=True, withStd=True).fit(v).transform(v)
    grow = (n / (n - 1)) ** 0.5 if n > 1 else 1.0  # Spark divides by the sample std
    s = s.withColumn("__z", array_to_vector(F.transform(vector_to_array("__z"), lambda x: x * grow))).cache()
    pca = PCA(k=2, inputCol="__z", outputCol="__c").fit(s)
    labelled = KMeans(k=clusters, seed=seed, featuresCol="__z", predictionCol="cluster").fit(s).transform(pca.transform(s))
    c = vector_to_array("__c")
    return labelled.select(*[x for x in days.columns if x not in HOURS], F.get(c, F.lit(0)).alias("pc1"), F.get(c, F.lit(1)).alias("pc2"), "cluster"), [float(x) for x in pca.explainedVariance]
