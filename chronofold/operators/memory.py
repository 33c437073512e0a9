"""Bounded memories: quantile, downsampled, sketched and hierarchical buffers."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Series

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
# Multipliers and offsets of the sketch's hash functions.
SKETCH = ((31, 17), (37, 23), (41, 29), (43, 31))


def quantile_of(sorted_values: Column, p: float) -> Column:
    """Linear interpolation between the two nearest of a sorted array."""
    at = F.lit(p) * (F.size(sorted_values) - 1)
    lo = F.floor(at).cast("int")
    a, b = F.get(sorted_values, lo), F.get(sorted_values, F.least(lo + 1, F.size(sorted_values) - 1))
    return a + (b - a) * (at - lo)


def quantiles(df: DataFrame, series: Series, x: str, n: int, every: int = 10, ps: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Quantiles of the last n values (zeros before the first), recomputed on each ``every``-th row and held between."""
    d = df.withColumn("_i", series.counter()).withColumn("_buf", series.buffer(F.col(x), n, 0.0))
    ordered = lambda buf: F.sort_array(F.transform(buf, lambda v: F.coalesce(v, F.lit(0.0))))
    now = F.when(F.col("_i") % every == 0, F.transform(F.array(ordered(F.col("_buf"))), lambda b: F.array(*[quantile_of(b, p) for p in ps])))
    d = d.withColumn("_now", F.get(now, 0)).withColumn("_q", F.last("_now", ignorenulls=True).over(series.so_far()))
    return d.withColumns({f"q{round(100 * p)}": F.get("_q", k) for k, p in enumerate(ps)}).drop("_i", "_buf", "_now", "_q")


def downsampled(df: DataFrame, series: Series, x: str, n: int, factor: int, out: str) -> DataFrame:
    """The last n // factor of every ``factor``-th value, oldest first, padded with zeros; held between."""
    d = df.withColumn("_on", series.counter() % factor == 0)
    own = Series((*series.key, "_on"), series.order)
    d = d.withColumn("_b", own.buffer(F.col(x), max(1, n // factor), 0.0))
    return d.withColumn(out, F.last(F.when(F.col("_on"), F.col("_b")), ignorenulls=True).over(series.so_far())).drop("_on", "_b")


def sketch(df: DataFrame, group: str, x: Column, buckets: int = 1024) -> DataFrame:
    """(group, item, estimate): count-min counts of int(x * 1000); each hash's buckets are pre-aggregated."""
    items = df.select(group, (x * 1000).cast("long").alias("item")).where("item is not null").groupBy(group, "item").agg(F.count(F.lit(1)).alias("n"))
    places = F.posexplode(F.array(*[F.pmod(F.lit(a) * F.col("item") + F.lit(b), F.lit(buckets)) for a, b in SKETCH])).alias("h", "bucket")
    counted = items.select(group, "item", "n", places).withColumn("c", F.sum("n").over(Window.partitionBy(group, "h", "bucket")))
    return counted.groupBy(group, "item").agg(F.min("c").alias("estimate"))


def hierarchical(df: DataFrame, series: Series, x: str, medium: int = 5, long: int = 50, alpha: float = 0.1, kept: int = 1000) -> DataFrame:
    """recent: the value; medium_ewma: mean of the 1st and each ``medium``-th row after it, held; long_median: on the 1st and each ``long``-th row after it, the median of such rows so far (``kept`` at most), and 0 between."""
    i = series.counter() - 1
    d = df.withColumn("recent", F.col(x)).withColumn("_m", i % medium == 0).withColumn("_l", i % long == 0)
    d = Series((*series.key, "_m"), series.order).ewma(d, x, "_me", alpha=alpha)
    d = d.withColumn("medium_ewma", F.last(F.when(F.col("_m"), F.col("_me")), ignorenulls=True).over(series.so_far()))
    own = Series((*series.key, "_l"), series.order)
    d = d.withColumn("_held", F.when(F.col("_l"), F.collect_list(F.col(x)).over(own.latest(kept))))
    return d.withColumn("long_median", F.when(F.col("_l"), quantile_of(F.sort_array("_held"), 0.5)).otherwise(F.lit(0.0))).drop("_m", "_l", "_me", "_held")


def memory_bytes(n: int, compression: str, item: int = 4, factor: int = 2, levels: int = 5, sketch_rows: int = 4, buckets: int = 1024) -> int:
    """Bytes that a buffer of n values takes under a compression."""
    sizes = {"none": n * item, "ewma": 3 * item, "quantile": min(n, 1000) * item + levels * item, "downsample": n // factor * item, "sketching": sketch_rows * buckets * item}
    if compression not in sizes:
        raise ValueError(f"unknown compression {compression!r}")
    return sizes[compression]


def hierarchical_memory(recent: int = 100, medium: int = 1000, long: int = 10_000, medium_kind: str = "ewma", long_kind: str = "quantile", item: int = 8) -> dict[str, float]:
    """Bytes of each level of a hierarchical buffer, their sum, and how many times smaller that is than plain buffers."""
    counter = 4

    def level(n: int, kind: str) -> int:
        sizes = {"ewma": 3 * counter, "quantile": min(n, 1000) * item + len(QUANTILES) * item + counter, "downsample": n // 2 * item + counter}
        return sizes.get(kind, n * item)

    used = {"recent": recent * item, "medium": level(medium, medium_kind), "long": level(long, long_kind)}
    total = sum(used.values())
    return used | {"total": total, "compression_ratio": (recent + medium + long) * item / total}


def compressed_memory(n: int, compression: str = "ewma", **how) -> Callable:
    """Decorator: a function of (df, series, x) sees x with the column ``memory``, its compressed past."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(df: DataFrame, series: Series, x: str) -> DataFrame:
            if compression == "ewma":
                seen = series.ewma(df, x, "memory", alpha=how.get("alpha", 0.1))
            elif compression == "quantile":
                seen = quantiles(df, series, x, n, ps=(0.5,)).withColumnRenamed("q50", "memory")
            elif compression == "downsample":
                seen = downsampled(df, series, x, n, how.get("factor", 2), "memory")
            elif compression == "none":
                seen = df.withColumn("memory", series.buffer(F.col(x), n, 0.0))
            else:
                raise ValueError(f"unknown compression {compression!r}")
            return f(seen, series, x)

        return run

    return wrap


def with_hierarchical_memory(**how) -> Callable:
    """Decorator: a function of (df, series, x) sees the three levels of ``hierarchical``."""

    def wrap(f: Callable) -> Callable:
        return functools.wraps(f)(lambda df, series, x: f(hierarchical(df, series, x, **how), series, x))

    return wrap


def recent(df: DataFrame, series: Series, n: int) -> DataFrame:
    """The last n rows of every key: a bounded history."""
    late = Window.partitionBy(*series.key).orderBy(*[F.col(c).desc() for c in series.order])
    return df.withColumn("_late", F.row_number().over(late)).where(F.col("_late") <= n).drop("_late")
