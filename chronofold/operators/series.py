"""Ordered series: frames, lags, fills, bars, rolling and exponentially weighted statistics.

A ``Series`` names the key columns and the order of a DataFrame; every method returns a
Column to be used in one ``select``, so that all windows of one frame share one exchange
and one sort. Missing is NULL throughout: ``value`` turns NaN into NULL on the way in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from . import fold

#: Span of the exponent within one block of an exponential scan; e**SPAN stays far from overflow.
SPAN = 200.0


def value(column: str | Column) -> Column:
    """A double in which NaN is NULL."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


@dataclass(frozen=True)
class Series:
    """Rows of one or more keys, each in the order of the given columns (the last breaks ties)."""

    key: tuple[str, ...] = ("user_id",)
    order: tuple[str, ...] = ("ts", "event_id")

    def window(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.key, *more).orderBy(*self.order)

    def so_far(self, *more: str) -> WindowSpec:
        return self.window(*more).rowsBetween(Window.unboundedPreceding, 0)

    def latest(self, n: int, *more: str) -> WindowSpec:
        return self.window(*more).rowsBetween(-(n - 1), 0)

    # ---- rows before ------------------------------------------------------------------

    def lag(self, x: Column, k: int = 1, fill=None) -> Column:
        return F.lag(x, k, fill).over(self.window())

    def diff(self, x: Column, k: int = 1) -> Column:
        return x - self.lag(x, k)

    def counter(self) -> Column:
        return F.row_number().over(self.window()).cast("long")

    def ffill(self, x: Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.so_far())

    def has_changed(self, x: Column, missing_changes: bool = True) -> Column:
        """True where the value differs from the row before, and on the first row; missing differs from missing unless told otherwise."""
        before = self.lag(x)
        first = F.row_number().over(self.window()) == 1
        differs = ~x.eqNullSafe(before)
        if missing_changes:
            differs = differs | x.isNull()
        return first | differs

    def buffer(self, x: Column, n: int, fill=None) -> Column:
        """The latest n values, oldest first, padded on the left."""
        got = F.transform(F.collect_list(F.struct(x.alias("v"))).over(self.latest(n)), lambda s: s["v"])
        return F.concat(F.array_repeat(F.lit(fill).cast("double"), F.lit(n) - F.size(got)), got)

    # ---- rolling and expanding ----------------------------------------------------------

    def rolling_mean(self, x: Column, n: int, least: int = 1) -> Column:
        w = self.latest(n)
        return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))

    def expanding_mean(self, x: Column) -> Column:
        return F.avg(x).over(self.so_far())

    def cumulative(self, x: Column) -> Column:
        return F.sum(x).over(self.so_far())

    def pct_change(self, df: DataFrame, x: str, out: str, fill: bool = True, zero_missing: bool = True) -> DataFrame:
        """x over the filled value before it, minus one; a missing value after a known one gives 0."""
        filled = df.withColumn("_f", self.ffill(F.col(x)) if fill else F.col(x)).withColumn("_p", self.lag(F.col("_f")))
        change = F.try_divide(F.col(x), F.col("_p")) - 1
        if zero_missing:
            change = F.when(F.col(x).isNull() & F.col("_p").isNotNull(), F.lit(0.0)).otherwise(change)
        return filled.withColumn(out, change).drop("_f", "_p")

    def ohlc(self, df: DataFrame, x: str, reset: Column | None = None) -> DataFrame:
        """Trailing open, high, low and close of the bar; ``reset`` starts a bar with its own row. close is kept over bars."""
        bars = df.withColumn("_bar", F.lit(0) if reset is None else F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(self.so_far()))
        w, c = self.so_far("_bar"), F.col(x)
        added = {"open": F.first(c, ignorenulls=True).over(w), "high": F.max(c).over(w), "low": F.min(c).over(w), "close": F.last(c, ignorenulls=True).over(self.so_far())}
        return bars.withColumns(added).drop("_bar")

    # ---- exponentially weighted ---------------------------------------------------------

    def ewma(
        self, df: DataFrame, x: str, out: str, *, alpha: float | None = None, com: float | None = None, adjust: bool | str = True,
        ignore_na: bool = False, min_periods: int = 0, initial: float | None = None,
    ) -> DataFrame:
        """Exponentially weighted mean of column ``x``.

        The recurrence m = a m + b x is affine with weights that depend on the pattern of
        missing values alone, so it is evaluated as sums of c_j exp(L_j - L_t) over blocks
        of the exponent L: a running sum within the block and one sum over the block
        before it; older blocks weigh less than e**-SPAN and vanish in double precision.
        """
        com = _com(alpha, com)
        if adjust == "linear":
            return self._linear(df, x, out, com, {"ignore_na": ignore_na, "min_periods": min_periods, "initial": initial})
        if com == 0:
            own = self.ffill(F.col(x))
            own = own if initial is None else F.coalesce(own, F.lit(float(initial)))
            return df.withColumn(out, F.when(F.count(F.col(x)).over(self.so_far()) >= min_periods, own))
        q, alpha = com / (1 + com), 1 / (1 + com)
        c = F.col(x)
        seen = F.count(c).over(self.so_far())
        d = df.withColumn("_ewn", seen).withColumn("_ewi", seen if ignore_na else F.row_number().over(self.window()))
        if adjust:
            d = d.withColumn("_ewl", F.when(c.isNotNull(), F.col("_ewi") * F.lit(-math.log(q))))
            d = self._scan(d, {"_ews": c, "_ewd": F.when(c.isNotNull(), F.lit(1.0))})
            s, w = F.col("_ews"), F.col("_ewd")
            if initial is not None:  # a virtual observation of weight one before the first row
                prior = F.exp(-F.col("_ewl"))
                s, w = s + F.lit(float(initial)) * prior, w + prior
            mean = s / w
        else:
            gap = F.lit(1) if ignore_na else F.col("_ewi") - F.coalesce(F.last(F.when(c.isNotNull(), F.col("_ewi")), ignorenulls=True).over(self.window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            d = d.withColumn("_eww", F.when(c.isNotNull(), F.pow(F.lit(q), gap)))
            start = (F.col("_ewn") == 1) & c.isNotNull() & F.lit(initial is None)
            loss = F.when(c.isNull(), F.lit(0.0)).when(start, F.lit(0.0)).otherwise(F.log(F.col("_eww") + alpha) - gap * math.log(q))
            d = d.withColumn("_ewl", F.sum(loss).over(self.so_far()))
            share = F.when(start, F.lit(1.0)).otherwise(F.lit(alpha) / (F.col("_eww") + alpha))
            d = self._scan(d.withColumn("_ewl", F.when(c.isNotNull(), F.col("_ewl"))), {"_ews": c * share})
            mean = F.col("_ews")
            if initial is not None:
                mean = mean + F.lit(float(initial)) * F.exp(-F.col("_ewl"))
        d = d.withColumn("_ewm", F.when(c.isNotNull(), mean))
        kept = F.last("_ewm", ignorenulls=True).over(self.so_far())
        if initial is not None:
            kept = F.coalesce(kept, F.lit(float(initial)))
        done = d.withColumn(out, F.when(F.col("_ewn") >= min_periods, kept))
        return done.drop("_ewn", "_ewi", "_ewl", "_ews", "_ewd", "_eww", "_ewm")

    def _scan(self, d: DataFrame, terms: dict[str, Column]) -> DataFrame:
        """Sums over earlier rows of term * exp(L_j - L_t); rows with a null L are skipped."""
        d = d.withColumn("_ewb", F.floor(F.col("_ewl") / SPAN))
        up = F.exp(F.col("_ewl") - F.col("_ewb") * SPAN)
        inside = self.so_far("_ewb")
        before = Window.partitionBy(*self.key).orderBy("_ewb").rangeBetween(-1, -1)
        for name, term in terms.items():
            late = term * F.exp(F.col("_ewl") - (F.col("_ewb") + 1) * SPAN)
            own = F.sum(term * up).over(inside) / up
            carried = F.coalesce(F.sum(late).over(before), F.lit(0.0)) / up
            d = d.withColumn(name, own + carried)
        return d.drop("_ewb")

    def _linear(self, df: DataFrame, x: str, out: str, com: float, how: dict) -> DataFrame:
        """adjust="linear": the weight grows by one per row up to com and a missing row takes one away, which has no closed form: an ordered fold."""
        step = fold.ewma_step(com=com, adjust="linear", ignore_na=how["ignore_na"], min_periods=how["min_periods"])
        start = fold.ewma_start(fold.NAN if how["initial"] is None else how["initial"])
        kept = [c for c in df.columns if c != out]
        return fold.fold(df, list(self.key), list(self.order), [x], step, start, f"{out} double", keep=kept).select(*kept, out)

    def ewma_together(self, df: DataFrame, columns: dict[str, str], *, alpha: float | None = None, com: float | None = None) -> DataFrame:
        """The adjusted means of several columns (output name -> column) in one scan.

        Where missing rows age a mean, the exponent is the row's number whatever is missing,
        so the columns share its blocks and each brings a sum and a weight.
        """
        com = _com(alpha, com)
        if com == 0:
            for out, x in columns.items():
                df = self.ewma(df, x, out, com=0.0)
            return df
        rate = -math.log(com / (1 + com))
        d = df.withColumn("_ewl", F.row_number().over(self.window()) * F.lit(rate))
        terms = {}
        for out, x in columns.items():
            terms |= {f"_ews_{out}": F.col(x), f"_ewd_{out}": F.when(F.col(x).isNotNull(), F.lit(1.0))}
        d = self._scan(d, terms)
        means = {out: F.last(F.when(F.col(x).isNotNull(), F.col(f"_ews_{out}") / F.col(f"_ewd_{out}")), ignorenulls=True).over(self.so_far()) for out, x in columns.items()}
        return d.withColumns(means).drop("_ewl", *terms)

    def ewmvar(self, df: DataFrame, x: str, out: str, *, alpha: float | None = None, com: float | None = None, adjust: bool = True) -> DataFrame:
        """Biased exponentially weighted variance; missing rows are skipped, leading ones give 0."""
        com = _com(alpha, com)
        c = F.col(x)
        d = df.withColumn("_xx", c * c)
        if adjust and com > 0:  # x and its square are missing together, and missing rows don't age: both share the count of seen rows
            seen = F.count(c).over(self.so_far())
            d = d.withColumn("_ewl", F.when(c.isNotNull(), seen * F.lit(-math.log(com / (1 + com)))))
            d = self._scan(d, {"_s1": c, "_s2": F.col("_xx"), "_sw": F.when(c.isNotNull(), F.lit(1.0))})
            both = F.when(c.isNotNull(), F.struct((F.col("_s1") / F.col("_sw")).alias("m1"), (F.col("_s2") / F.col("_sw")).alias("m2")))
            d = d.withColumn("_m", F.last(both, ignorenulls=True).over(self.so_far())).withColumns({"_m1": F.col("_m.m1"), "_m2": F.col("_m.m2")}).drop("_m", "_s1", "_s2", "_sw", "_ewl")
        else:
            for name, source in (("_m1", x), ("_m2", "_xx")):
                d = self.ewma(d, source, name, com=com, adjust=adjust, ignore_na=True)
        return d.withColumn(out, F.coalesce(F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)), F.lit(0.0))).drop("_xx", "_m1", "_m2")

    def ewmcov(self, df: DataFrame, x: str, y: str, out: str, *, assume_centered: bool = False, **how) -> DataFrame:
        """Exponentially weighted covariance of two columns of a row."""
        d = df.withColumn("_xy", F.col(x) * F.col(y))
        means = {"_mxy": "_xy"} if assume_centered else {"_mxy": "_xy", "_mx": x, "_my": y}
        if set(how) <= {"alpha", "com"}:
            d = self.ewma_together(d, means, **how)
        else:
            for name, source in means.items():
                d = self.ewma(d, source, name, **how)
        cov = F.col("_mxy") if assume_centered else F.col("_mxy") - F.col("_mx") * F.col("_my")
        return d.withColumn(out, cov).drop("_xy", *means)


def _com(alpha: float | None, com: float | None) -> float:
    if (alpha is None) == (com is None):
        raise ValueError("give either alpha or com")
    if com is None:
        if not 0 < alpha <= 1:
            raise ValueError("alpha must be in (0, 1]")
        return 1 / alpha - 1
    if com < 0:
        raise ValueError("com must not be negative")
    return com


class Ewm:
    """``Ewm(series, alpha=...).mean(df, x)``: the windows of pandas' ``ewm``."""

    def __init__(self, series: Series, **how):
        self.series, self.how = series, how

    def mean(self, df: DataFrame, x: str, out: str = "mean") -> DataFrame:
        return self.series.ewma(df, x, out, **self.how)


# ---- masks -----------------------------------------------------------------------------------


def apply_mask(mask: Column, x: Column, fill: float = 0.0) -> Column:
    return F.when(mask, x).otherwise(F.lit(fill))


def fill_nan_inf(x: Column, fill: float = 0.0) -> Column:
    c = x.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(fill)).otherwise(c)


def mask_mean(mask: Column, x: Column) -> Column:
    """Aggregate: a masked missing value counts as zero."""
    return F.try_divide(F.sum(F.when(mask, F.coalesce(x, F.lit(0.0)))), F.count_if(mask))


def mask_std(mask: Column, x: Column, assume_centered: bool = False) -> Column:
    """Aggregate: population deviation over the mask."""
    z = F.when(mask, F.coalesce(x, F.lit(0.0)))
    return F.sqrt(F.avg(z * z)) if assume_centered else F.stddev_pop(z)


def mask_normalize(df: DataFrame, group: str, mask: Column, x: Column, out: str, assume_centered: bool = False) -> DataFrame:
    """x over its group's masked deviation; 0 where that is zero or x is missing. The group's statistics are pre-aggregated, then joined."""
    stats = df.groupBy(group).agg(mask_std(mask, x, assume_centered).alias("_std"))
    return df.join(stats, group).withColumn(out, fill_nan_inf(F.try_divide(x, F.when(F.col("_std") > 0, F.col("_std"))))).drop("_std")
