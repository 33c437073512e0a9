"""Indicators composed of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import scan_with_reset
from .series import Series


def bollinger(df: DataFrame, series: Series, x: str, window: int = 20, width: float = 2.0) -> DataFrame:
    """middle, upper, lower and position; the deviation is of the window's values, 0 with fewer than two."""
    d = series.ewma(df, x, "middle", alpha=2 / (window + 1))
    w = series.latest(window)
    std = F.when(F.count(F.col(x)).over(w) > 1, F.stddev_pop(F.col(x)).over(w)).otherwise(F.lit(0.0))
    d = d.withColumn("_s", width * std).withColumns({"upper": F.col("middle") + F.col("_s"), "lower": F.col("middle") - F.col("_s")})
    span = F.col("upper") - F.col("lower")
    return d.withColumn("position", F.when(span > 1e-8, F.try_divide(F.col(x) - F.col("lower"), span)).otherwise(F.lit(0.5))).drop("_s")


def macd(df: DataFrame, series: Series, x: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    d = series.ewma(series.ewma(df, x, "_f", alpha=2 / (fast + 1)), x, "_s", alpha=2 / (slow + 1))
    d = d.withColumn("macd", F.col("_f") - F.col("_s"))
    d = series.ewma(d, "macd", "signal", alpha=2 / (signal + 1))
    return d.withColumn("histogram", F.col("macd") - F.col("signal")).drop("_f", "_s")


def position_size(signal: Column, risk: float = 0.02) -> Column:
    """The signal's direction, scaled by its strength, within the risk."""
    return F.signum(signal) * F.least(F.abs(signal), F.lit(1.0)) * risk


def signal_processor(df: DataFrame, series: Series, x: str) -> DataFrame:
    """tanh((fast - slow) / (volatility + 1e-6))"""
    d = series.ewma(series.ewma(df, x, "_f", alpha=0.3), x, "_s", alpha=0.05)
    d = series.ewmvar(d, x, "_v", alpha=0.1)
    return d.withColumn("signal", F.tanh((F.col("_f") - F.col("_s")) / (F.sqrt("_v") + 1e-6))).drop("_f", "_s", "_v")


def regime_signal(df: DataFrame, series: Series, x: str, threshold: float = 1.0, window: int = 50, fast: float = 0.3, slow: float = 0.05) -> DataFrame:
    """volatility, regime and signal: each regime's rows have an exponential mean to themselves, quicker where the volatility is above the threshold.

    The volatility is the deviation of the last ``window`` values, which start as copies of the first.
    """
    first = F.first(F.col(x)).over(series.so_far())
    d = df.withColumn("_off", F.col(x) - first)
    w = series.latest(window)
    mean, square = F.sum("_off").over(w) / window, F.sum(F.col("_off") * F.col("_off")).over(w) / window
    d = d.withColumn("volatility", F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).withColumn("_high", F.col("volatility") > threshold)
    own = Series((*series.key, "_high"), series.order)
    d = own.ewma(own.ewma(d, x, "_fast", alpha=fast), x, "_slow", alpha=slow)
    return d.withColumns({"regime": F.when(F.col("_high"), "high_vol").otherwise("low_vol"), "signal": F.when(F.col("_high"), F.col("_fast")).otherwise(F.col("_slow"))}).drop("_off", "_high", "_fast", "_slow")


def log_return(x: Column) -> Column:
    """log(x + 1e-8), missing where x is not above -1e-8."""
    return F.when(x + 1e-8 > 0, F.log(x + 1e-8))


def cumulative_returns(df: DataFrame, series: Series, x: str) -> DataFrame:
    """return and cumulative: log returns and their sum, which starts anew after each negative value."""
    d = df.withColumn("return", log_return(F.col(x)))
    return scan_with_reset(d, series, F.col(x) < 0, lambda e, s: e.withColumn("cumulative", s.cumulative(F.col("return"))))
