"""Base curves: rule-based hourly forecasts from comparable past days, for all keys and days in one job.

History is keyed by (key, month-day) and (key, weekday); target days number at most ninety a key.  No step
works day by day, and no join lacks an equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions.calendar import holiday_flags, is_christmas, mmdd
from wattloom.functions.expressions import array_sum, hours_array, mean_profile, normalised, row_sum, scaled, wide
from wattloom.schema import HOURS
from wattloom.session import stored

#: How many same days count, weights and factors of the Christmas blend.
SAME_DAY_CHRISTMAS, SAME_DAY_VERY_SPECIAL, SAME_DAY_HOLIDAY, RECENT_DAYS = 3, 2, 5, 60


def targets(keys_df: DataFrame, start: str, end: str, holidays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, FECHA, flags, route): every day of the range for every key; Christmas season goes before holidays."""
    t = keys_df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("FECHA"))
    t = holiday_flags(t, holidays, keys).drop("festivo_nombre")
    return t.withColumns({"dow": F.weekday("FECHA"), "mmdd": mmdd("FECHA"), "route": F.when(is_christmas("FECHA"), "christmas").when(F.col("es_festivo"), "holiday").otherwise("normal")})


def history_of(df: DataFrame, holidays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h_date, h_total, h_hours, h_shares, h_hol, dow, mmdd); a null total is the sum of the hours."""
    d = holiday_flags(df, holidays, keys).withColumn("__t", row_sum(HOURS))
    hours = hours_array()
    total = F.coalesce(F.col("TOTAL"), F.col("__t")) if "TOTAL" in df.columns else F.col("__t")
    return d.select(*keys, F.col("FECHA").alias("h_date"), total.alias("h_total"), hours.alias("h_hours"), normalised(hours, F.col("__t")).alias("h_shares"), F.col("es_festivo").alias("h_hol"), F.weekday("FECHA").alias("dow"), mmdd("FECHA").alias("mmdd"))


def same_day(t: DataFrame, h: DataFrame, keys: list[str], most: int = SAME_DAY_HOLIDAY) -> DataFrame:
    """For each target the latest `most` earlier rows of its month-day, numbered from the latest."""
    j = t.select(*keys, "FECHA", "mmdd").join(h.drop("dow"), [*keys, "mmdd"]).where(F.col("h_date") < F.col("FECHA"))
    w = Window.partitionBy(*keys, "FECHA").orderBy(F.col("h_date").desc())
    return j.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def same_day_stats(t: DataFrame, h: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, FECHA, same_n, total3, total2, shares3, shares2, hours5) from the same days of earlier years."""
    s = same_day(t, h, keys)
    upto = lambda c, k: F.when(F.col("n") <= k, F.col(c))
    s = s.withColumns({"__s3": upto("h_shares", 3), "__s2": upto("h_shares", 2)})
    return s.groupBy(*keys, "FECHA").agg(
        F.count(F.lit(1)).alias("same_n"), F.avg(upto("h_total", SAME_DAY_CHRISTMAS)).alias("total3"), F.avg(upto("h_total", SAME_DAY_VERY_SPECIAL)).alias("total2"),
        mean_profile("__s3").alias("shares3"), mean_profile("__s2").alias("shares2"), mean_profile("h_hours").alias("hours5"),
    )


def recent_stats(t: DataFrame, h: DataFrame, keys: list[str], days: int = RECENT_DAYS) -> DataFrame:
    """(keys, FECHA, recent_dow, recent_all): mean total of non-holidays in the `days` before a target, of its
    weekday and of any.  One join on key and month bucket; a target looks into the buckets that its range meets."""
    bucket = lambda c: F.expr(f"(year({c}) * 12 + month({c}))")
    wide_t = t.select(*keys, "FECHA", F.col("dow").alias("t_dow"), F.explode(F.sequence(F.expr(f"year(date_sub(FECHA, {days})) * 12 + month(date_sub(FECHA, {days}))"), bucket("FECHA"))).alias("b"))
    j = wide_t.join(h.where(~F.col("h_hol")).select(*keys, "h_date", "h_total", "dow", bucket("h_date").alias("b")), [*keys, "b"])
    j = j.where((F.col("h_date") < F.col("FECHA")) & (F.col("h_date") >= F.date_sub("FECHA", days)))
    return j.groupBy(*keys, "FECHA").agg(F.avg(F.when(F.col("dow") == F.col("t_dow"), F.col("h_total"))).alias("recent_dow"), F.avg("h_total").alias("recent_all"))


def christmas_total() -> Column:
    """Weekdays blend the same day's mean with recent ones of the weekday, half and half up to 27 December and 60
    to 40 later; without recent ones, and on weekends, a factor applies."""
    late = ((F.month("FECHA") == 12) & (F.dayofmonth("FECHA") >= 28)) | (F.month("FECHA") == 1)
    blend = F.when(late, F.col("total3") * 0.6 + F.col("recent_dow") * 0.4).otherwise(F.col("total3") * 0.5 + F.col("recent_dow") * 0.5)
    alone = F.col("total3") * F.when(late, 1.10).otherwise(1.08)
    return F.when(F.col("dow") < 5, F.coalesce(blend, alone)).otherwise(F.col("total3") * F.when(late, 1.05).otherwise(1.03))


def normal_tiers(t: DataFrame, h: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, FECHA, tier, tier_total, tier_hours) of the first tier that has rows: same weekday in the month
    before (1), in this month before the day (2), in the two months before (3), in this month of the two
    years before (4), all as non-holidays; then all non-holidays from two years before on (5), the same
    with holidays (6), all history (7).  Tiers 1 to 4 are one join on key and weekday, from which a row
    takes part in its lowest tier and those above that it fits; 5 to 7 come from daily sums by key."""
    f = F.col("FECHA")
    j = t.select(*keys, "FECHA", "dow").join(h.drop("mmdd").where((~F.col("h_hol"))), [*keys, "dow"]).where((F.col("h_date") < f) & (F.col("h_date") >= F.add_months(f, -26)))
    month = lambda c: F.trunc(c, "month")
    fits = F.array(
        month("h_date") == month(F.add_months(f, -1)), month("h_date") == month(f), F.col("h_date") >= F.add_months(f, -2),
        (F.month("h_date") == F.month(f)) & (F.col("h_date") >= F.add_months(f, -24)),
    )
    tiers = j.withColumn("tier", F.explode(F.filter(F.array(*[F.when(F.get(fits, F.lit(k)), F.lit(k + 1)) for k in range(4)]), lambda x: x.isNotNull())))
    near = tiers.groupBy(*keys, "FECHA", "tier").agg(F.avg("h_total").alias("tier_total"), mean_profile("h_hours").alias("tier_hours"))
    near = near.groupBy(*keys, "FECHA").agg(F.min_by(F.struct("tier", "tier_total", "tier_hours"), "tier").alias("x"))
    # from a date on: running sums from the latest day back, found as of the first day at or after the bound
    w = Window.partitionBy(*keys).orderBy(F.col("h_date").desc())
    sums = [F.array(*[F.sum(F.when(c, F.get("h_hours", F.lit(k)))).over(w) for k in range(24)]).alias(n) for n, c in (("s5", ~F.col("h_hol")), ("s6", F.lit(True)))]
    back = h.select(*keys, "h_date", *[F.sum(F.when(c, F.col("h_total"))).over(w).alias(f"t{n}") for n, c in ((5, ~F.col("h_hol")), (6, F.lit(True)))], *[F.count(F.when(c, 1)).over(w).alias(f"n{n}") for n, c in ((5, ~F.col("h_hol")), (6, F.lit(True)))], *sums)
    bound = t.select(*keys, "FECHA", F.add_months("FECHA", -24).alias("at"))
    both = back.select(*keys, F.col("h_date").alias("at"), F.lit(None).cast("date").alias("FECHA"), F.struct("t5", "n5", "s5", "t6", "n6", "s6").alias("v"))
    both = both.unionByName(bound.withColumn("v", F.lit(None).cast(both.schema["v"].dataType)))
    upto = Window.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("FECHA").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = both.withColumn("v", F.last("v", ignorenulls=True).over(upto)).where("FECHA is not null").select(*keys, "FECHA", "v")
    overall = h.groupBy(*keys).agg(F.avg("h_total").alias("all_total"), mean_profile("h_hours").alias("all_hours"))
    d = t.select(*keys, "FECHA").join(near, [*keys, "FECHA"], "left").join(far, [*keys, "FECHA"], "left").join(overall, keys, "left")
    has5, has6 = F.coalesce(F.col("v.n5") > 0, F.lit(False)), F.coalesce(F.col("v.n6") > 0, F.lit(False))
    mean = lambda n: F.transform(F.col(f"v.s{n}"), lambda s: s / F.col(f"v.n{n}"))
    return d.select(
        *keys, "FECHA", F.coalesce("x.tier", F.when(has5, 5), F.when(has6, 6), F.lit(7)).alias("tier"),
        F.coalesce("x.tier_total", F.when(has5, F.col("v.t5") / F.col("v.n5")), F.when(has6, F.col("v.t6") / F.col("v.n6")), "all_total").alias("tier_total"),
        F.coalesce("x.tier_hours", F.when(has5, mean(5)), F.when(has6, mean(6)), F.transform(F.sequence(F.lit(1), F.lit(24)), lambda _: F.col("all_total") / 24)).alias("tier_hours"),
    )


def holiday_fallback(h: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h_month, hol_total, hol_shares): holidays of a month in any year, later ones too."""
    return h.where("h_hol").groupBy(*keys, F.month("h_date").alias("h_month")).agg(F.avg("h_total").alias("hol_total"), mean_profile("h_shares").alias("hol_shares"))


def base_curves(df: DataFrame, start: str, end: str, holidays: DataFrame, keys: list[str], model=None) -> DataFrame:
    """(keys, FECHA, route, source, curve, P1..P24): 24 values for every day of the range.  `model` is a fitted
    HourlyModel or None; `source` names the rule that gave the curve.  History and targets are written once, as seven
    lookups read them: each reads the columns it needs, and the plan doesn't hold the history's own seven times."""
    h = stored(history_of(df, holidays, keys), "history")
    t = stored(targets(h, start, end, holidays, keys), "targets")
    overall = h.groupBy(*keys).agg(F.avg("h_total").alias("g_total"))
    d = t.join(same_day_stats(t.where("route <> 'normal'"), h, keys), [*keys, "FECHA"], "left").join(recent_stats(t.where("route = 'christmas'"), h, keys), [*keys, "FECHA"], "left")
    d = d.join(normal_tiers(t.where("route = 'normal'"), h, keys), [*keys, "FECHA"], "left").join(overall, keys, "left")
    d = d.withColumn("h_month", F.month("FECHA")).join(holiday_fallback(h, keys), [*keys, "h_month"], "left")
    if model is not None:
        d = d.join(model.by_weekday.withColumnRenamed("cluster", "__n"), [*keys, "dow"], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
        d = d.join(model.normal.select(*keys, F.col("cluster").alias("__n"), F.col("profile").alias("p_normal")), [*keys, "__n"], "left")
        d = d.join(model.by_mmdd.withColumnRenamed("cluster", "__s"), [*keys, "mmdd"], "left").join(model.special.select(*keys, F.col("cluster").alias("__s"), F.col("profile").alias("__ps")), [*keys, "__s"], "left")
        d = d.join(model.average.withColumnRenamed("profile", "__pa"), keys, "left").withColumn("p_special", F.coalesce("__ps", "__pa"))
    else:
        none = F.lit(None).cast("array<double>")
        d = d.withColumns({"p_normal": none, "p_special": none})
    flat = lambda x: F.transform(F.sequence(F.lit(1), F.lit(24)), lambda _: x / 24)
    recent = F.coalesce("recent_all", "g_total")
    very = F.col("mmdd").isin("12-25", "01-01")
    same = F.coalesce(F.col("same_n") > 0, F.lit(False))
    rules = [
        ("same_day", (F.col("route") == "christmas") & same & very, scaled(F.col("shares2"), F.col("total2"))),
        ("christmas_cluster", (F.col("route") == "christmas") & same & F.col("p_normal").isNotNull(), scaled(F.col("p_normal"), christmas_total())),
        ("christmas_history", (F.col("route") == "christmas") & same, scaled(F.col("shares3"), christmas_total())),
        ("special_profile", (F.col("route") == "christmas") & F.col("p_special").isNotNull(), scaled(F.col("p_special"), recent)),
        ("flat", F.col("route") == "christmas", flat(recent)),
        ("same_day", (F.col("route") == "holiday") & same, F.col("hours5")),
        ("holiday_month", (F.col("route") == "holiday") & F.col("hol_total").isNotNull(), scaled(F.col("hol_shares"), F.col("hol_total"))),
        ("special_profile", (F.col("route") == "holiday") & F.col("p_special").isNotNull(), scaled(F.col("p_special"), F.col("g_total"))),
        ("flat", F.col("route") == "holiday", flat(F.col("g_total"))),
        ("normal_cluster", F.col("p_normal").isNotNull(), scaled(F.col("p_normal"), F.col("tier_total"))),
    ]
    curve, source = F.col("tier_hours"), F.concat(F.lit("tier_"), F.col("tier").cast("string"))
    for name, cond, value in reversed(rules):
        curve, source = F.when(cond, value).otherwise(curve), F.when(cond, F.lit(name)).otherwise(source)
    d = d.withColumn("curve", padded(curve)).withColumn("source", source)
    return d.select(*keys, "FECHA", "route", "source", "tier", "curve", *wide(F.col("curve")))


def padded(a: Column, n: int = 24) -> Column:
    """Exactly n values: longer arrays are cut, shorter ones filled with 0."""
    return F.slice(F.concat(F.coalesce(a, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), n)), 1, n)


def choose_source(requests: DataFrame, forecast: DataFrame, curves: DataFrame, keys: list[str], kind: str = "tipopronostico") -> DataFrame:
    """For each requested day the forecast's hours (Modelo IA) or the base curve's (Modelo Base)."""
    f = forecast.select(*keys, "FECHA", F.col("hours").alias("__f"))
    c = curves.select(*keys, "FECHA", F.col("curve").alias("__c"))
    d = requests.join(f, [*keys, "FECHA"], "left").join(c, [*keys, "FECHA"], "left")
    return d.withColumn("hours", F.when(F.col(kind) == "Modelo IA", F.col("__f")).when(F.col(kind) == "Modelo Base", F.col("__c"))).drop("__f", "__c")


def reference_day(df: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, fecha_referencia) with that day's 24 hours (null if the day is unknown)."""
    d = df.groupBy(*keys, F.col("FECHA").alias("fecha_referencia")).agg(*[F.max(c).alias(c) for c in HOURS])
    return asked.join(d.select(*keys, "fecha_referencia", hours_array().alias("ref")), [*keys, "fecha_referencia"], "left")


def hour_deltas(df: DataFrame, keys: list[str], hours: str = "hours", ref: str = "ref") -> DataFrame:
    """(keys, FECHA, periodo, value, reference, delta, delta_pct, relation), a row for each hour."""
    z = F.arrays_zip(F.col(hours).alias("v"), F.col(ref).alias("r"))
    d = df.select(*keys, "FECHA", F.posexplode(z).alias("k", "x")).select(*keys, "FECHA", (F.col("k") + 1).alias("periodo"), F.col("x.v").alias("value"), F.col("x.r").alias("reference"))
    delta = F.col("value") - F.col("reference")
    return d.withColumns({"delta": delta, "delta_pct": F.try_divide(delta * 100, F.col("reference")), "relation": F.when(F.abs(delta) < 1e-9, "igual").when(delta > 0, "superior").otherwise("inferior")})


def clamp_to_reference(df: DataFrame, hours: str = "hours", ref: str = "ref", total: str = "TOTAL", band: float = 0.05) -> DataFrame:
    """Hours kept within 5 % of the reference day's (an hour of 0 there keeps the prediction), then scaled to the
    total again; not scaled if they sum to 0 or less."""
    near = F.zip_with(hours, ref, lambda v, r: F.when(F.coalesce(r, F.lit(0.0)) == 0, v).otherwise(F.greatest(F.least(v, r * (1 + band)), r * (1 - band))))
    d = df.withColumn("__c", near).withColumn("__s", array_sum(F.col("__c")))
    scale = F.when(F.col("__s") > 0, F.col(total) / F.col("__s")).otherwise(F.lit(1.0))
    return d.withColumn("adjusted", F.transform("__c", lambda x: x * scale)).drop("__c", "__s")
