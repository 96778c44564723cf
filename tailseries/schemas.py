"""Declared schemas of the stored tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

from tailseries import config as C


def _doubles(names) -> list[T.StructField]:
    return [T.StructField(name, T.DoubleType(), True) for name in names]


OBSERVATIONS = T.StructType(
    [
        T.StructField(C.STATION, T.StringType(), True),
        T.StructField(C.TIME, T.TimestampType(), True),
        T.StructField(C.DEPTH, T.DoubleType(), True),
        *_doubles(C.OCEAN_VALUES),
    ]
)

WEATHER_LONG = T.StructType(
    [
        T.StructField(C.STATION, T.StringType(), True),
        T.StructField("date", T.TimestampType(), True),
        T.StructField("parameter", T.StringType(), True),
        T.StructField("value", T.DoubleType(), True),
    ]
)

WEATHER_DAILY = T.StructType(
    [
        T.StructField(C.STATION, T.StringType(), True),
        T.StructField(C.TIME, T.DateType(), True),
        *_doubles(C.WEATHER_VALUES),
    ]
)

WEEKLY = T.StructType(
    [
        T.StructField(C.STATION, T.StringType(), True),
        T.StructField(C.DEPTH, T.DoubleType(), True),
        T.StructField(C.TIME, T.DateType(), True),
        T.StructField(C.TIME_INDEX, T.IntegerType(), True),
        *_doubles(C.VALUE_COLUMNS),
        *_doubles(C.KNOWN_COVARIATES),
    ]
)

EPISODES = T.StructType(
    [
        T.StructField(C.STATION, T.StringType(), True),
        T.StructField(C.DEPTH, T.DoubleType(), True),
        T.StructField("start_date", T.DateType(), True),
        T.StructField("end_date", T.DateType(), True),
        T.StructField("duration_weeks", T.LongType(), True),
        T.StructField("min_o2", T.DoubleType(), True),
    ]
)
