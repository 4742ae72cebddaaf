"""Calendar columns: weekdays, seasons, holidays, special days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.expressions import flag

#: Weekday names, Monday first.
WEEKDAYS = ["LUNES", "MARTES", "MIÉRCOLES", "JUEVES", "VIERNES", "SÁBADO", "DOMINGO"]
#: Texts of TIPO DIA that mean a working day.
WORKING = ["LUNES", "MARTES", "MIERCOLES", "MIÉRCOLES", "JUEVES", "VIERNES"]
#: Names by month-day.
HOLIDAY_NAMES = {
    "01-01": "Año Nuevo", "01-06": "Día de los Reyes Magos", "03-19": "Día de San José", "04-17": "Jueves Santo", "04-18": "Viernes Santo", "05-01": "Día del Trabajo",
    "06-02": "Ascensión del Señor", "06-23": "Corpus Christi", "06-30": "Sagrado Corazón de Jesús", "07-20": "Día de la Independencia", "08-07": "Batalla de Boyacá",
    "08-17": "Asunción de la Virgen", "10-12": "Día de la Raza", "11-02": "Día de Todos los Santos", "11-16": "Independencia de Cartagena", "12-08": "Inmaculada Concepción", "12-25": "Navidad",
}
#: Rainy months for features and for the day classifier (they differ), and special month-days.
RAINY_FEATURES, RAINY_CLASSIFIER = [4, 5, 10, 11], [4, 5, 9, 10, 11]
SPECIAL_CALENDAR, SPECIAL_IF_HOLIDAY, SPECIAL_SPLIT = ["01-01", "01-02", "12-24", "12-25", "12-08"], ["05-01", "07-20"], ["12-24", "01-02"]


def mmdd(date: str) -> Column:
    return F.date_format(F.col(date), "MM-dd")


def weekday_name(date: str) -> Column:
    return F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(F.col(date)))


def is_christmas(date: str) -> Column:
    """December 23 to January 6."""
    m, d = F.month(F.col(date)), F.dayofmonth(F.col(date))
    return ((m == 12) & (d >= 23)) | ((m == 1) & (d <= 6))


def day_class(tipo_dia: str) -> Column:
    """LABORAL for a Monday-to-Friday name in any case, else (null too) FESTIVO.  Not idempotent: LABORAL itself becomes FESTIVO."""
    return F.when(F.upper(F.col(tipo_dia)).isin(*WORKING), "LABORAL").otherwise("FESTIVO")


def calendar_features(df: DataFrame, date: str = "FECHA", festivo: Column | None = None) -> DataFrame:
    """The 15 calendar columns; is_festivo is TIPO DIA = FESTIVO unless another condition is given."""
    c = F.col(date)
    dow = F.weekday(c)
    holiday = F.col("TIPO DIA") == "FESTIVO" if festivo is None else festivo
    return df.withColumns({
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "dayofweek": dow, "dayofyear": F.dayofyear(c), "week": F.weekofyear(c), "quarter": F.quarter(c),
        "is_weekend": flag(dow >= 5), "is_saturday": flag(dow == 5), "is_sunday": flag(dow == 6), "is_month_start": flag(F.dayofmonth(c) == 1), "is_month_end": flag(c == F.last_day(c)),
        "is_quarter_start": flag(c == F.trunc(c, "quarter")), "is_quarter_end": flag(c == F.last_day(F.add_months(F.trunc(c, "quarter"), 2))), "is_festivo": flag(holiday),
    })


def cyclic_features(df: DataFrame, mode: str = "train") -> DataFrame:
    """Sine and cosine of weekday, month and day of year.  When serving, months count from 0."""
    month = F.col("month") if mode == "train" else F.col("month") - 1
    turn = lambda x, n: F.lit(2 * math.pi) * x / n
    out = {}
    for name, x, n in (("dayofweek", F.col("dayofweek"), 7), ("month", month, 12), ("dayofyear", F.col("dayofyear"), 365)):
        out |= {f"{name}_sin": F.sin(turn(x, n)), f"{name}_cos": F.cos(turn(x, n))}
    return df.withColumns(out)


def season_features(df: DataFrame, date: str = "FECHA") -> DataFrame:
    c = F.col(date)
    m, d = F.month(c), F.dayofmonth(c)
    rainy, christmas = m.isin(*RAINY_FEATURES), is_christmas(date)
    return df.withColumns({
        "season": F.when(rainy, "rainy").otherwise("dry"), "is_rainy_season": flag(rainy), "is_january": flag(m == 1), "is_december": flag(m == 12), "week_of_month": F.floor((d - 1) / 7).cast("int") + 1,
        "is_christmas_season": flag(christmas), "is_post_season": flag((m == 1) & d.between(7, 15)), "is_high_season": flag(~christmas),
    })


def holiday_flags(df: DataFrame, holidays: DataFrame, keys: list[str], date: str = "FECHA") -> DataFrame:
    """df with es_festivo and the calendar's own name (null if it has none).  The calendar holds some twenty
    rows a key and year; it is joined on keys and date, and AQE broadcasts it where it is small."""
    h = holidays.groupBy(*keys, "FECHA").agg(F.max("nombre").alias("__nombre")).withColumn("__hol", F.lit(True))
    h = h.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("FECHA").alias("__d"), "__nombre", "__hol")
    on = F.col(date) == F.col("__d")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(h, on, "left").withColumn("es_festivo", F.coalesce("__hol", F.lit(False))).withColumn("festivo_nombre", F.col("__nombre")).drop("__d", "__hol", "__nombre", *[f"__{k}" for k in keys])


def classify_days(df: DataFrame, holidays: DataFrame, keys: list[str], date: str = "FECHA") -> DataFrame:
    """Weekday name, day type (holiday over weekend over working day), holiday name, season, month, quarter, special-day flags."""
    d = holiday_flags(df, holidays, keys, date)
    weekend = F.weekday(F.col(date)) >= 5
    names = F.create_map(*[F.lit(x) for kv in HOLIDAY_NAMES.items() for x in kv])
    return d.withColumns({
        "dia_semana": weekday_name(date),
        "tipo_dia": F.when(F.col("es_festivo"), "festivo").when(weekend, "fin_de_semana").otherwise("laboral"),
        "nombre_festivo": F.when(F.col("es_festivo"), F.coalesce(F.try_element_at(names, mmdd(date)), F.lit("Festivo"))).otherwise("No festivo"),
        "es_fin_semana": weekend, "temporada": F.when(F.month(F.col(date)).isin(*RAINY_CLASSIFIER), "lluviosa").otherwise("seca"), "mes": F.month(F.col(date)), "trimestre": F.quarter(F.col(date)),
        "dia_especial": mmdd(date).isin(*SPECIAL_CALENDAR) | (F.col("es_festivo") & mmdd(date).isin(*SPECIAL_IF_HOLIDAY)), "dia_especial_reparto": mmdd(date).isin(*SPECIAL_SPLIT) | F.col("es_festivo"),
    }).drop("festivo_nombre")
