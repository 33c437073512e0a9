"""Tables and synthetic series."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with x: their value, missing on every seventh id from 3."""
    return table(spark, folder, "events").withColumn("x", F.when(F.col("event_id") % 7 != 3, F.col("value")))


def from_records(spark: SparkSession, records: Iterable[dict], schema: str, batch: int = 10_000) -> DataFrame:
    """A stream of records as a table with _step, their number; records are taken in batches, so the driver holds one at a time."""
    parts, rows, n = [], [], 0

    def flush() -> None:
        if rows:
            parts.append(spark.createDataFrame(list(rows), f"_step long, {schema}"))
            rows.clear()

    for record in records:
        rows.append({"_step": n, **record})
        n += 1
        if len(rows) == batch:
            flush()
    flush()
    out = parts[0] if parts else spark.createDataFrame([], f"_step long, {schema}")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_scalar(df: DataFrame, value: DataFrame, name: str) -> DataFrame:
    """``df`` with the one value of a one-row, one-column table on every row; no row gives NULL, several raise."""
    kind = value.schema[0].dataType
    rows: list[Row] = value.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("a scalar has one row")
    return df.withColumn(name, F.lit(rows[0][0] if rows else None).cast(kind))


def access_rows(df: DataFrame, data: DataFrame, index: Column, step: str = "step") -> DataFrame:
    """``df`` with the columns of the row of ``data`` that ``index`` names by its ``step``; a negative or unknown index gives NULLs."""
    asked = df.withColumn("_index", F.when(index >= 0, index))
    return asked.join(data.withColumnRenamed(step, "_index"), "_index", "left").drop("_index")


# ---- synthetic sources: long tables of time, lat, lon and values, uniform in [0, 1) ---------------------


def coordinates(n_lat: int = 25, n_lon: int = 53, n_time: int = 124, freq: str = "h") -> tuple[np.ndarray, np.ndarray, pd.DatetimeIndex]:
    return np.linspace(75, 15, n_lat), np.linspace(200, 330, n_lon), pd.date_range("2000-01-01", periods=n_time, freq=freq)


def _long(spark: SparkSession, name: str, values: np.ndarray, lats, lons, times, time: str = "time") -> DataFrame:
    index = pd.MultiIndex.from_product([times, lats, lons], names=[time, "lat", "lon"])
    return spark.createDataFrame(pd.DataFrame({name: values.ravel()}, index=index).reset_index())


def grid(spark: SparkSession, n_lat: int = 25, n_lon: int = 53, n_time: int = 124, freq: str = "h", seed: int = 3, name: str = "air", time: str = "time") -> DataFrame:
    """Values on a grid: time, lat, lon, ``name``."""
    lats, lons, times = coordinates(n_lat, n_lon, n_time, freq)
    return _long(spark, name, np.random.default_rng(seed).random((n_time, n_lat, n_lon)), lats, lons, times, time)


def times_grid(spark: SparkSession, n_lat: int = 25, n_lon: int = 53, n_time: int = 124, freq: str = "h") -> DataFrame:
    """Times as values: every grid point's data is its own time."""
    lats, lons, times = coordinates(n_lat, n_lon, n_time, freq)
    return _long(spark, "data", np.repeat(times.to_numpy(), n_lat * n_lon), lats, lons, times)


def two_time_scales(spark: SparkSession, days: int = 12, hours: int = 124, **size) -> tuple[DataFrame, DataFrame]:
    """(daily air by day, hourly ground by time)"""
    return grid(spark, n_time=days, freq="D", name="air", time="day", **size), grid(spark, n_time=hours, freq="h", name="ground", **size)
