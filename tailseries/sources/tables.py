"""Stored tables: hourly weather, daily weather, weekly and labelled series."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tailseries import config as C
from tailseries import schemas
from tailseries.sources import published

YEAR, VERSION, DAILY = "year", "version", "daily"
#: Name of the slot of rows without a station.
NO_STATION = "__none"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session.

    Only a local session without such a folder, as in tests, gets a temporary one; on a cluster the
    executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tailseries-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several steps read, and read it back.

    It lies in the shared scratch folder, so it survives the loss of executors, and readers
    fetch only the columns they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def staged_by(df: DataFrame, name: str, by: Sequence[str], tasks: int) -> DataFrame:
    """As ``staged``, in so many buckets by some columns: windows per series that read it need no shuffle of it.

    Rows that lie in as many tasks by these columns already are written as they lie, one file each. Readers take the
    buckets from the table's entry in the catalog, which is gone once the table has been opened.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "staged_" + path.rsplit("-", 1)[1]
    df.write.format("parquet").bucketBy(tasks, *by).option("path", path).saveAsTable(table)
    try:
        return spark.read.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def write_weather_long(readings: DataFrame, path: str) -> None:
    """Land hourly readings, foldered by station and year.

    Only the folders of stations and years that ``readings`` has are replaced; all others stay.
    """
    (
        readings.withColumn(YEAR, F.year("date"))
        .select(C.STATION, "date", "parameter", "value", YEAR)
        .repartition(C.STATION, YEAR)
        .sortWithinPartitions(C.STATION, YEAR, "parameter", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(C.STATION, YEAR)
        .parquet(path)
    )


def _of_stations(table: DataFrame, stations: Sequence[str] | DataFrame | None) -> DataFrame:
    if stations is None:
        return table
    if isinstance(stations, DataFrame):
        return table.join(stations.select(F.col(C.STATION).cast("string")).distinct(), C.STATION, "left_semi")
    return table.where(F.col(C.STATION).isin(list(stations)))


def read_weather_long(
    spark: SparkSession,
    path: str,
    *,
    stations: Sequence[str] | DataFrame | None = None,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """Landed hourly readings in long form, of some stations and of the years from the first to the last given.

    Folders are pruned before anything is read: by a list of stations when planning, by a table of
    stations (column station_id) when it has been read, as Spark hands its keys to the scan.
    """
    schema = T.StructType([*schemas.WEATHER_LONG.fields, T.StructField(YEAR, T.IntegerType())])
    table = spark.read.schema(schema).parquet(path)
    if years is not None:
        table = table.where(F.col(YEAR).between(*years))
    return _of_stations(table, stations).select(schemas.WEATHER_LONG.fieldNames())


def write_weather_daily(daily: DataFrame, path: str) -> None:
    """Replace the daily table of the stations that ``daily`` has; others stay as they are.

    The rows are written as a new version of each station, which is then put in force for all of them at once. Until
    then readers have the former rows, and so they have for ever if the run dies.
    """
    version = published.new_version()
    daily = staged(daily, "weather-daily")
    (
        daily.repartition(C.STATION, F.year(C.TIME))
        .sortWithinPartitions(C.STATION, C.TIME)
        .withColumn(VERSION, F.lit(version))
        .write.mode("append")
        .partitionBy(VERSION, C.STATION)
        .parquet(f"{path}/{DAILY}")
    )
    slots = daily.select(F.coalesce(C.STATION, F.lit(NO_STATION)).alias("slot")).distinct()
    published.publish(slots, path, version)


def read_weather_daily(
    spark: SparkSession, path: str, *, stations: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """The daily table as published, of all stations or of those in a list or table (column station_id)."""
    held = published.in_force(spark, path).select(
        F.nullif("slot", F.lit(NO_STATION)).alias("_slot"), F.col("version").alias("_version")
    )
    schema = T.StructType([*schemas.WEATHER_DAILY.fields, T.StructField(VERSION, T.StringType())])
    if published.exists(spark, f"{path}/{DAILY}"):
        table = spark.read.schema(schema).parquet(f"{path}/{DAILY}")
    else:
        table = spark.createDataFrame([], schema)
    table = _of_stations(table, stations)
    of_version = (F.col(VERSION) == F.col("_version")) & F.col(C.STATION).eqNullSafe(F.col("_slot"))
    return table.join(held, of_version, "left_semi").select(schemas.WEATHER_DAILY.fieldNames())


def remove_older_weather(spark: SparkSession, path: str, *, keep: int = 1) -> list[str]:
    """Delete versions of the daily table that hold for no station any more."""
    return published.remove_older(spark, path, [DAILY], keep=keep)


def write_series_table(df: DataFrame, path: str, *, partition_by: str = C.DEPTH) -> None:
    """Weekly or labelled rows, foldered by depth and sorted so that readers can prune.

    Depth has few values; folders per station would mean millions of small files.
    """
    keys = [k for k in (C.STATION,) if k in df.columns]
    (
        df.repartition(partition_by, *keys)
        .sortWithinPartitions(*keys, C.TIME)
        .write.mode("overwrite")
        .partitionBy(partition_by)
        .parquet(path)
    )
