"""Column lists and explicit schemas of the demand-series tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: The column names of the feeds.
HOURS = [f"P{h}" for h in range(1, 25)]
DEMAND_COLUMNS = ["UCP", "VARIABLE", "FECHA", "Clasificador interno", "TIPO DIA", *HOURS, "TOTAL"]
WEATHER_HOURLY = ["fecha", "periodo", "p_t", "p_h", "p_v", "p_i"]
WEATHER_DAILY = ["FECHA", "temp_mean", "temp_min", "temp_max", "temp_std", "humidity_mean", "humidity_min", "humidity_max", "wind_speed_mean", "wind_speed_max", "rain_mean", "rain_sum"]
KEYS = ["UCP"]

#: Everything is read as text and coerced by column, so that one bad value is one null.
DEMAND_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in DEMAND_COLUMNS])
WEATHER_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in ["UCP", *WEATHER_HOURLY]])
DEMAND_FEED = T.StructType([T.StructField("data", T.ArrayType(T.StructType([T.StructField("fecha", T.StringType()), *[T.StructField(f"p{h}", T.DoubleType()) for h in range(1, 25)]])))])
WEATHER_FEED = T.StructType([T.StructField("data", T.ArrayType(T.StructType([T.StructField("fecha", T.StringType()), *[T.StructField(f"p{h}_{v}", T.DoubleType()) for h in range(1, 25) for v in "thvi"]])))])
HOLIDAY_FILE = T.StructType([T.StructField("festivos", T.ArrayType(T.StringType())), T.StructField("descripcion_festivos", T.MapType(T.StringType(), T.StringType()))])
