"""Scalar functions: time floors, 64-bit splits, label codes, scaling, arrays, and trees of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_datetime(time: Column, unit: str = "day") -> Column:
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def encode_int64(x: Column) -> tuple[Column, Column]:
    """(high, low) 32 bits, both unsigned."""
    low = x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned(x.cast("long"), 32), low


def decode_int64(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32) + low


def encode_timestamp(time: Column) -> tuple[Column, Column]:
    """(high, low) 32 bits of the nanoseconds since 1970."""
    return encode_int64(F.unix_micros(time.cast("timestamp")) * 1000)


def decode_timestamp(high: Column, low: Column) -> Column:
    """The microsecond that the nanoseconds lie in; whole-number division, since nanoseconds of today need more bits than a double has."""
    nanos = decode_int64(high, low)
    micros = F.call_function("div", nanos, F.lit(1000).cast("long")) - (nanos % 1000 < 0).cast("long")
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def less(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Order of two split integers."""
    return (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))


def label_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): codes of the sorted distinct labels, from 0.

    Distinct labels are dealt by ranges, and a label's code is its place in its range plus
    the sizes of the ranges before, so neither labels nor rows meet in one task.
    """
    labels = df.select(column).where(F.col(column).isNotNull()).distinct()
    dealt = labels.repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id())
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1)
    return placed.join(sizes.select("_part", before.alias("_before")), "_part").select(column, (F.col("_own") + F.col("_before")).cast("long").alias(out))


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the codes of its labels; a missing label has none."""
    return df.join(label_codes(df, column, out), column, "left")


def label_decode(df: DataFrame, codes: DataFrame, code: str, column: str) -> DataFrame:
    """``df`` with the labels of its codes, by a table from ``label_codes``; unknown codes give NULL."""
    return df.join(codes.select(code, column), code, "left")


def min_max_scale(x: Column, low: Column, high: Column) -> Column:
    return F.try_divide(x - low, high - low)


def min_max_unscale(y: Column, low: Column, high: Column) -> Column:
    return y * (high - low) + low


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


# ---- arrays ------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def outer(a: Column, b: Column) -> Column:
    """Array of rows: every value of a times b."""
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def matvec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))


def roll(a: Column, k: int) -> Column:
    """Values moved k places to the right, around the end."""
    at = F.pmod(F.lit(k), F.greatest(F.size(a), F.lit(1)))
    return F.concat(F.slice(a, F.size(a) - at + 1, at), F.slice(a, F.lit(1), F.size(a) - at))


def stack(*columns: Column) -> Column:
    return F.array(*columns)


def access(values: Column, index: Column) -> Column:
    """The array's value at a row index from 0; a negative or too large one gives NULL."""
    return F.when(index >= 0, F.get(values, index.cast("int")))


# ---- trees: nested dictionaries, lists and tuples of columns ----------------------------------------


def tree_map(f: Callable, tree, *more):
    """``f`` on the leaves of equally shaped trees."""
    if isinstance(tree, dict):
        return {k: tree_map(f, v, *(m[k] for m in more)) for k, v in tree.items()}
    if isinstance(tree, (list, tuple)):
        return type(tree)(tree_map(f, *vs) for vs in zip(tree, *more, strict=True))
    return f(tree, *more)


def tree_leaves(tree) -> list:
    out: list = []
    tree_map(out.append, tree)
    return out


def tree_struct(tree) -> Column:
    """A tree of columns as one struct column; items of lists are named by their number."""
    if isinstance(tree, dict):
        return F.struct(*[tree_struct(v).alias(str(k)) for k, v in tree.items()])
    if isinstance(tree, (list, tuple)):
        return F.struct(*[tree_struct(v).alias(f"_{k}") for k, v in enumerate(tree)])
    return tree
