"""The library's queries over the driver's tables, and the DuckDB SQL that they are held against.

Series are events by user in the order (ts, event_id); x is the value, missing on every
seventh id. Doubles that are summed in another order by the two sides are rounded to six
places on both; folds do the same operations in the same order, and are not rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.functions import scalar
from chronofold.operators import events as ev
from chronofold.operators import fold as fd
from chronofold.operators import indicators as ix
from chronofold.operators import memory as mem
from chronofold.operators import series as ts
from chronofold.operators import sync as sy
from chronofold.sources import tables
from chronofold.streaming import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

S = ts.Series()

E = "e AS (SELECT event_id, user_id, ts, event_type, value, CASE WHEN event_id % 7 <> 3 THEN value END AS x FROM events)"
W = "PARTITION BY user_id ORDER BY ts, event_id"
U = f"{W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def x() -> Column:
    return F.col("x")


def v() -> Column:
    return F.col("value")


def query(name: str, sql: str | None = None):
    """Register a query; a short ``sql`` is a list of columns over the events."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if " FROM " in sql.upper() and sql.lstrip().upper().startswith(("WITH", "SELECT")) else f"WITH {E} SELECT event_id, {sql} FROM e"
        return f

    return register


def over_events(name: str, make: Callable[[], dict[str, Column]], sql: str) -> None:
    """A query whose columns are windows or scalars over the events."""
    query(name, sql)(lambda spark, d: tables.events(spark, d).select("event_id", *[c.alias(n) for n, c in make().items()]))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def dbl(value: float) -> str:
    """A double literal, exact in SQL."""
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"


def dot_sql(a: list[str], b: list[str]) -> str:
    """The same sum, from left to right, as the folds make."""
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def picked(df: DataFrame, *names: str, keep: str = "event_id") -> DataFrame:
    return df.select(keep, *[r6(n).alias(n) for n in names])


def recursive(state: dict[str, tuple[str, str]], out: str, value: str = "r.x", more: str = "", kind: dict[str, str] | None = None, where: str = "") -> str:
    """A fold in SQL: state column -> (start, step); the step sees f (state before) and r (the row)."""
    kind = kind or {}
    cast = lambda c, e: f"CAST({e} AS {kind.get(c, 'DOUBLE')}) AS {c}"
    start = ", ".join(cast(c, a) for c, (a, _) in state.items())
    step = ", ".join(cast(c, b) for c, (_, b) in state.items())
    return (
        f"WITH RECURSIVE {E}, r AS (SELECT *, row_number() OVER ({W}) AS i FROM e{more}), "
        f"f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, {start} FROM (SELECT DISTINCT user_id FROM e) UNION ALL "
        f"SELECT r.user_id, r.i, {step} FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1) "
        f"SELECT r.event_id, {out} FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i {where}"
    )


# ---- T1: rows before, fills, frames, scalars ---------------------------------------------------

over_events("lag_1", lambda: {"y": S.lag(x())}, f"lag(x) OVER ({W}) AS y")
over_events("lag_2", lambda: {"y": S.lag(v(), 2, 0.0)}, f"lag(value, 2, 0) OVER ({W}) AS y")
over_events("tree_lag", lambda: {"a": S.lag(x()), "b": S.lag(F.col("event_type"))}, f"lag(x) OVER ({W}) AS a, lag(event_type) OVER ({W}) AS b")
over_events("diff", lambda: {"y": r6(S.diff(x()))}, f"round(x - lag(x) OVER ({W}), 6) AS y")
over_events("ffill", lambda: {"y": S.ffill(x())}, f"last_value(x IGNORE NULLS) OVER ({U}) AS y")
over_events("counter", lambda: {"n": S.counter()}, f"row_number() OVER ({W}) AS n")
over_events("has_changed", lambda: {"y": S.has_changed(F.col("event_type"))}, f"(row_number() OVER ({W}) = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER ({W})) AS y")
over_events("has_changed_missing", lambda: {"y": S.has_changed(x())}, f"(row_number() OVER ({W}) = 1 OR x IS NULL OR x IS DISTINCT FROM lag(x) OVER ({W})) AS y")
over_events("rolling_mean", lambda: {"y": r6(S.rolling_mean(x(), 10))}, f"round(avg(x) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS y")
over_events("rolling_mean_minp", lambda: {"y": r6(S.rolling_mean(x(), 5, 5))}, f"round(CASE WHEN count(x) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5 THEN avg(x) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 6) AS y")
over_events("expanding_mean", lambda: {"y": r6(S.expanding_mean(x()))}, f"round(avg(x) OVER ({U}), 6) AS y")
over_events("cumulative_regret", lambda: {"y": r6(S.cumulative((v() - 50.0) * (v() - 50.0)))}, f"round(sum((value - 50) * (value - 50)) OVER ({U}), 6) AS y")
over_events("multi_projection", lambda: {"fast": r6(S.rolling_mean(x(), 3)), "slow": r6(S.rolling_mean(x(), 30)), "twice": r6(v() * 2)}, f"round(avg(x) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS fast, round(avg(x) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS slow, round(value * 2, 6) AS twice")
over_events("apply_mask", lambda: {"y": ts.apply_mask(F.col("event_type") == "purchase", v())}, "CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS y")
over_events("fill_nan_inf", lambda: {"y": ts.fill_nan_inf(F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("inf"))).otherwise(x()))}, "CASE WHEN event_id % 5 IN (0, 1) THEN 0 ELSE coalesce(x, 0) END AS y")
over_events("floor_datetime", lambda: {"day": scalar.floor_datetime(F.col("ts")), "hour": scalar.floor_datetime(F.col("ts"), "hour")}, "CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour")
over_events("encode_int64", lambda: dict(zip(("high", "low"), scalar.encode_int64(F.col("event_id") * 7_000_000_019))), "(event_id * 7000000019) // 4294967296 AS high, (event_id * 7000000019) % 4294967296 AS low")
over_events("clip", lambda: {"y": scalar.clip(v(), 10.0, 60.0)}, "greatest(least(value, 60.0), 10.0) AS y")
over_events("conditional_passthrough", lambda: {"y": ev.conditional(v() > 50, v() * 2, v())}, "CASE WHEN value > 50 THEN value * 2 ELSE value END AS y")
over_events("hierarchical_blend", lambda: {"y": ev.blend(v(), S.cumulative(F.round(v() * 100).cast("long")) / S.counter() / 100)}, f"0.9 * value + 0.1 * (sum(CAST(round(value * 100) AS BIGINT)) OVER ({U}) / row_number() OVER ({W}) / 100) AS y")
over_events("position_sizing", lambda: {"y": r6(ix.position_size((v() - 50) / 40))}, "round(sign((value - 50) / 40) * least(abs((value - 50) / 40), 1.0) * 0.02, 6) AS y")
over_events("lookback_pairs", lambda: {"target": F.array_join(F.transform(S.buffer(v(), 3, -1.0), lambda a: F.round(a, 2).cast("decimal(18,2)").cast("string")), ","), "before": S.lag(v())}, f"concat_ws(',', {', '.join(f'CAST(CAST(round(lag(value, {k}, -1.0) OVER ({W}), 2) AS DECIMAL(18,2)) AS VARCHAR)' for k in (2, 1, 0))}) AS target, lag(value) OVER ({W}) AS before")
over_events("buffer", lambda: {f"b{k}": F.get(S.buffer(x(), 4), F.lit(k)) for k in range(4)}, ", ".join(f"lag(x, {3 - k}) OVER ({W}) AS b{k}" for k in range(4)))
over_events("int64_round_trip", lambda: {"back": scalar.decode_int64(*scalar.encode_int64(F.col("event_id") * -7_000_000_019)), "later": scalar.less(scalar.encode_int64(F.lit(50_000_000_000_000)), scalar.encode_int64(F.col("event_id") * 7_000_000_019))}, "event_id * -7000000019 AS back, event_id * 7000000019 > 50000000000000 AS later")
over_events("timestamp_round_trip", lambda: (lambda high, low: {"high": high, "low": low, "back": scalar.decode_timestamp(high, low)})(*scalar.encode_timestamp(F.col("ts"))), "epoch_ns(ts) // 4294967296 AS high, epoch_ns(ts) % 4294967296 AS low, CAST(ts AS TIMESTAMP) AS back")
over_events("array_ops", lambda: (lambda a, b: {"dot": r6(scalar.dot(a, b)), "cross": r6(F.get(F.get(scalar.outer(a, b), F.lit(1)), F.lit(2))), "rolled": r6(F.get(scalar.roll(a, 1), F.lit(0))), "back": r6(F.get(scalar.roll(a, -1), F.lit(0))), "product": r6(F.get(scalar.matvec(F.array(b, a), a), F.lit(1))), "second": r6(scalar.access(a, F.col("event_id") % 4 - 1))})(scalar.stack(v(), v() / 2, F.lit(3.0)), F.array(F.lit(0.5), F.lit(2.0), v() / 10)), "round(value * 0.5 + value + 0.3 * value, 6) AS dot, round(value * value / 20, 6) AS cross, 3.0 AS rolled, round(value / 2, 6) AS back, round(value * value * 1.25 + 9, 6) AS product, round(CASE event_id % 4 WHEN 1 THEN value WHEN 2 THEN value / 2 WHEN 3 THEN 3 END, 6) AS second")
over_events("relevant_states", lambda: (lambda found: {**{f"s{k}": F.get(found[0], F.lit(k)) for k in (0, 1)}, "weight": r6(F.get(found[1], F.lit(0)))})(ev.relevant_states(ev.history(S, v(), 4), 2)), f"coalesce(lag(value, 4) OVER ({W}), lag(value, 3) OVER ({W}), lag(value, 2) OVER ({W}), lag(value, 1) OVER ({W})) AS s0, CASE WHEN lag(value, 4) OVER ({W}) IS NOT NULL THEN lag(value, 3) OVER ({W}) WHEN lag(value, 3) OVER ({W}) IS NOT NULL THEN lag(value, 2) OVER ({W}) WHEN lag(value, 2) OVER ({W}) IS NOT NULL THEN lag(value, 1) OVER ({W}) END AS s1, round(1.0 / nullif(least(row_number() OVER ({W}) - 1, 4), 0), 6) AS weight")


@query("attention_state", f"WITH {E}, h AS (SELECT event_id, value / 100 AS q, list_filter([{', '.join(f'lag(value / 100, {k}) OVER ({W})' for k in (4, 3, 2, 1))}], lambda v: v IS NOT NULL) AS past FROM e), p AS (SELECT *, list_max(list_transform(past, lambda v: v * q)) AS top FROM h) SELECT event_id, round(CASE WHEN len(past) = 0 THEN q ELSE q + 0.1 * list_sum(list_transform(past, lambda v: v * exp(v * q - top))) / list_sum(list_transform(past, lambda v: exp(v * q - top))) END, 6) AS y FROM p")
def _(spark, d):
    e = tables.events(spark, d).withColumn("q", v() / 100)
    return picked(e.withColumn("past", ev.history(S, F.col("q"), 4)).withColumn("y", ev.attended(F.col("q"), F.col("past"))), "y")


@query("sparse_window_filter", f"WITH {E} SELECT event_id, missing FROM (SELECT event_id, 8 - count(x) OVER ({W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS missing FROM e) WHERE missing < 0.25 * 8")
def _(spark, d):
    e = tables.events(spark, d).withColumn("buf", S.buffer(x(), 8))
    return e.select("event_id", F.size(F.filter("buf", lambda a: a.isNull())).cast("long").alias("missing")).where(F.col("missing") < 0.25 * 8)


over_events("conditional_signal", lambda: {"y": r6(F.coalesce(F.last(F.when(v() > 80, v()), ignorenulls=True).over(S.so_far()), F.lit(-999.0)))}, f"round(coalesce(last_value(CASE WHEN value > 80 THEN value END IGNORE NULLS) OVER ({U}), -999), 6) AS y")


@query("value_threshold", "SELECT event_id, value FROM events WHERE value > 75")
def _(spark, d):
    return tables.table(spark, d, "events").where("value > 75").select("event_id", "value")


@query("step_interval", f"SELECT event_id, n FROM (SELECT event_id, row_number() OVER ({W}) AS n FROM events) WHERE n % 10 = 0")
def _(spark, d):
    return tables.events(spark, d).select("event_id", S.counter().alias("n")).where("n % 10 = 0")


def _same(state, row):
    return (float(row[0]),), state


@query("skip_first", f"SELECT event_id, value AS y FROM (SELECT *, row_number() OVER ({W}) AS n FROM events) WHERE n > 1")
def _(spark, d):
    return _folded(spark, d, ["value"], (_same, lambda: None), "y double", skip_first=True).select("event_id", "y")


@query("stop_after_n", f"SELECT event_id, value AS y FROM (SELECT *, row_number() OVER ({W}) AS n FROM events) WHERE n <= 3")
def _(spark, d):
    return _folded(spark, d, ["value"], (_same, lambda: None), "y double", stop=3).select("event_id", "y")


@query("recent_rows", "SELECT event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def _(spark, d):
    return mem.recent(tables.events(spark, d), S, 3).select("event_id", "value")


@query("indexed_access", "SELECT e.event_id, d.value AS y FROM events e LEFT JOIN events d ON d.event_id = e.event_id - 5 AND e.event_id >= 5")
def _(spark, d):
    data = tables.table(spark, d, "events").select(F.col("event_id").alias("step"), F.col("value").alias("y"))
    return tables.access_rows(tables.table(spark, d, "events").select("event_id"), data, F.col("event_id") - 5).select("event_id", "y")


@query("scalar_broadcast", "SELECT event_id, value - m AS y FROM events CROSS JOIN (SELECT max(value) AS m FROM events)")
def _(spark, d):
    e = tables.table(spark, d, "events")
    return tables.with_scalar(e, e.agg(F.max("value").alias("m")), "m").select("event_id", (v() - F.col("m")).alias("y"))


@query("train_valid_split", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' ELSE 'valid' END AS part FROM events")
def _(spark, d):
    before = F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")
    return tables.table(spark, d, "events").select("event_id", F.when(before, "train").otherwise("valid").alias("part"))


@query("pct_change", f"WITH {E}, f AS (SELECT *, last_value(x IGNORE NULLS) OVER ({U}) AS f FROM e), p AS (SELECT *, lag(f) OVER ({W}) AS p FROM f) SELECT event_id, round(CASE WHEN x IS NULL AND p IS NOT NULL THEN 0 WHEN p <> 0 THEN x / p - 1 END, 6) AS y FROM p")
def _(spark, d):
    return picked(S.pct_change(tables.events(spark, d), "x", "y"), "y")


@query("ohlc_trailing", f"WITH {E} SELECT event_id, first_value(x IGNORE NULLS) OVER ({U}) AS open, max(x) OVER ({U}) AS high, min(x) OVER ({U}) AS low, last_value(x IGNORE NULLS) OVER ({U}) AS close FROM e")
def _(spark, d):
    return S.ohlc(tables.events(spark, d), "x").select("event_id", "open", "high", "low", "close")


_BAR = "PARTITION BY user_id, bar ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("ohlc_daily", f"WITH {E}, b AS (SELECT *, date_trunc('day', ts) AS bar FROM e) SELECT event_id, first_value(x IGNORE NULLS) OVER ({_BAR}) AS open, max(x) OVER ({_BAR}) AS high, min(x) OVER ({_BAR}) AS low, last_value(x IGNORE NULLS) OVER ({U}) AS close FROM b")
def _(spark, d):
    e = tables.events(spark, d).withColumn("day", scalar.floor_datetime(F.col("ts")))
    return S.ohlc(e, "x", S.has_changed(F.col("day"))).select("event_id", "open", "high", "low", "close")


@query("label_encode", "WITH l AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, code FROM events JOIN l USING (event_type)")
def _(spark, d):
    return scalar.label_encode(tables.table(spark, d, "events"), "event_type", "code").select("event_id", "code")


@query("label_decode", "WITH l AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, code, event_type AS label FROM events JOIN l USING (event_type)")
def _(spark, d):
    e = tables.table(spark, d, "events")
    codes = scalar.label_codes(e, "event_type", "code")
    coded = scalar.label_encode(e.select("event_id", "event_type"), "event_type", "code").drop("event_type")
    return scalar.label_decode(coded, codes, "code", "event_type").select("event_id", "code", F.col("event_type").alias("label"))


over_events("min_max_unscale", lambda: {"y": r6(scalar.min_max_unscale(scalar.min_max_scale(v(), F.lit(10.0), F.lit(60.0)), F.lit(10.0), F.lit(60.0)))}, "round((value - 10) / 50 * 50 + 10, 6) AS y")


@query("min_max_scale", "WITH s AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY user_id) SELECT event_id, round((value - lo) / nullif(hi - lo, 0), 6) AS y FROM events JOIN s USING (user_id)")
def _(spark, d):
    e = tables.table(spark, d, "events")
    s = e.where(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")).groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(s, "user_id").select("event_id", r6(scalar.min_max_scale(v(), F.col("lo"), F.col("hi"))).alias("y"))


# ---- aggregates ------------------------------------------------------------------------------------


@query("per_step_sum", "SELECT date_trunc('hour', ts) AS step, round(sum(value), 6) AS total FROM events GROUP BY 1")
def _(spark, d):
    return tables.table(spark, d, "events").groupBy(scalar.floor_datetime(F.col("ts"), "hour").alias("step")).agg(r6(F.sum("value")).alias("total"))


@query("batch_mean", f"WITH {E}, m AS (SELECT row_number() OVER ({W}) AS step, avg(x) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y FROM e) SELECT step, round(avg(y), 6) AS y FROM m GROUP BY step")
def _(spark, d):
    e = tables.events(spark, d).select(S.counter().alias("step"), S.rolling_mean(x(), 5).alias("y"))
    return e.groupBy("step").agg(r6(F.avg("y")).alias("y"))


def _masked(name: str, make: Callable[[], Column], sql: str) -> None:
    @query(name, f"WITH {E} SELECT user_id, round({sql}, 6) AS y FROM e GROUP BY user_id")
    def _(spark, d):
        return tables.events(spark, d).groupBy("user_id").agg(r6(make()).alias("y"))


_mask = lambda: F.col("event_type").isin("view", "click")
_Z = "CASE WHEN event_type IN ('view', 'click') THEN coalesce(x, 0) END"
_masked("mask_mean", lambda: ts.mask_mean(_mask(), x()), f"avg({_Z})")
_masked("mask_std", lambda: ts.mask_std(_mask(), x()), f"stddev_pop({_Z})")
_masked("mask_std_centered", lambda: ts.mask_std(_mask(), x(), True), f"sqrt(avg({_Z} * {_Z}))")


@query("mask_normalize", f"WITH {E}, s AS (SELECT user_id, stddev_pop({_Z}) AS sd FROM e GROUP BY user_id) SELECT event_id, round(coalesce(x / nullif(sd, 0), 0), 6) AS y FROM e JOIN s USING (user_id)")
def _(spark, d):
    return picked(ts.mask_normalize(tables.events(spark, d), "user_id", _mask(), x(), "y"), "y")


# ---- exponentially weighted ------------------------------------------------------------------------


def _ewma_sql(alpha: float, adjust=True, ignore_na=False, least=0, initial=None, column="x") -> str:
    com = 1 / alpha - 1
    q, new = com / (1 + com), 1.0 if adjust else alpha
    c = f"r.{column}"
    if adjust == "linear":
        within = f"least(f.w, {dbl(com)})"
        decayed = f"CASE WHEN f.m IS NULL THEN 0 WHEN {c} IS NOT NULL OR {ignore_na} THEN {within} WHEN f.w <= 0 THEN 0 ELSE {within} * greatest(0, (f.w - 1) / f.w) END"
    else:
        factor = f"CASE WHEN {c} IS NULL THEN 1 ELSE {q!r} END" if ignore_na else repr(q)
        decayed = f"CASE WHEN f.m IS NULL THEN 0 ELSE f.w * {factor} END"
    state = {
        "m": ("NULL" if initial is None else repr(initial), f"CASE WHEN {c} IS NULL THEN f.m WHEN f.m IS NULL THEN {c} ELSE (({decayed}) * f.m + {new!r} * {c}) / (({decayed}) + {new!r}) END"),
        "w": ("1", f"CASE WHEN {c} IS NULL THEN {decayed} ELSE {f'({decayed}) + {new!r}' if adjust else '1'} END"),
        "n": ("0", f"f.n + CASE WHEN {c} IS NULL THEN 0 ELSE 1 END"),
    }
    return recursive(state, f"round(CASE WHEN f.n >= {least} THEN f.m END, 6) AS y")


def _ewma(name: str, column: str = "x", **how) -> None:
    sql = _ewma_sql(how["alpha"], how.get("adjust", True), how.get("ignore_na", False), how.get("min_periods", 0), how.get("initial"), column)
    query(name, sql)(lambda spark, d: picked(S.ewma(tables.events(spark, d), column, "y", **how), "y"))


_ewma("ewma_adjust", alpha=0.1)
_ewma("ewma_noadjust", alpha=0.1, adjust=False)
_ewma("ewma_ignore_na", alpha=0.2, ignore_na=True)
_ewma("ewma_noadjust_ignore_na", alpha=0.2, adjust=False, ignore_na=True)
_ewma("ewma_min_periods", alpha=0.1, min_periods=5)
_ewma("ewma_init", alpha=0.1, initial=2.0)
_ewma("ewma_noadjust_init", alpha=0.1, adjust=False, initial=2.0)
_ewma("ewma_linear", alpha=0.1, adjust="linear")
_ewma("ewma_linear_short", alpha=0.4, adjust="linear", min_periods=2, initial=30.0)
_ewma("ewma_linear_ignore_na", alpha=0.3, adjust="linear", ignore_na=True)
query("ewm_accessor", _ewma_sql(0.25, column="value"))(lambda spark, d: picked(ts.Ewm(S, alpha=0.25).mean(tables.events(spark, d), "value", "y"), "y"))


def _ewmvar_sql(alpha: float, adjust: bool) -> str:
    com = 1 / alpha - 1
    q, new = com / (1 + com), 1.0 if adjust else alpha
    w = f"CASE WHEN f.a IS NULL THEN 0 WHEN r.x IS NULL THEN f.w ELSE f.w * {q!r} END"
    mean = lambda c, e: f"CASE WHEN r.x IS NULL THEN f.{c} WHEN f.{c} IS NULL THEN {e} ELSE (({w}) * f.{c} + {new!r} * {e}) / (({w}) + {new!r}) END"
    state = {"a": ("NULL", mean("a", "r.x")), "b": ("NULL", mean("b", "(r.x * r.x)")), "w": ("1", f"CASE WHEN r.x IS NULL THEN {w} ELSE {f'({w}) + {new!r}' if adjust else '1'} END")}
    return recursive(state, "round(coalesce(greatest(f.b - f.a * f.a, 0), 0), 6) AS y")


for _name, _adjust in (("ewmvar", True), ("ewmvar_noadjust", False)):
    query(_name, _ewmvar_sql(0.2, _adjust))(lambda spark, d, a=_adjust: picked(S.ewmvar(tables.events(spark, d), "x", "y", alpha=0.2, adjust=a), "y"))

_COV = f"WITH {E}, r AS (SELECT *, value * 0.5 + event_id % 13 AS z, row_number() OVER ({W}) AS i FROM e), m AS (SELECT a.event_id, sum(b.value * pow(0.9, a.i - b.i)) / sum(pow(0.9, a.i - b.i)) AS mx, sum(b.z * pow(0.9, a.i - b.i)) / sum(pow(0.9, a.i - b.i)) AS mz, sum(b.value * b.z * pow(0.9, a.i - b.i)) / sum(pow(0.9, a.i - b.i)) AS mxz FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id) SELECT event_id, round("
for _name, _centered, _sql in (("ewmcov", False, "mxz - mx * mz"), ("ewmcov_centered", True, "mxz")):
    query(_name, _COV + _sql + ", 5) AS y FROM m")(lambda spark, d, c=_centered: S.ewmcov(tables.events(spark, d).withColumn("z", v() * 0.5 + F.col("event_id") % 13), "value", "z", "y", alpha=0.1, assume_centered=c).select("event_id", F.round("y", 5).alias("y")))


@query("ewma_warm_start", _ewma_sql(0.1))
def _(spark, d):
    """Two halves, the second started from the first one's final states."""
    e = tables.events(spark, d).withColumn("late", F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    step = fd.ewma_step(alpha=0.1)

    def carrying(state, row):
        if state is None:
            state = (float(row[1]), float(row[2]), int(row[3])) if row[3] >= 0 else fd.ewma_start()()
        (y,), state = step(state, row[:1])
        return (y, *state), state

    out = "y double, mean double, weight double, n long"
    blank = {"mean0": F.lit(None).cast("double"), "weight0": F.lit(None).cast("double"), "n0": F.lit(-1).cast("long")}
    inputs = ["x", "mean0", "weight0", "n0"]
    early = fd.fold(e.where("not late").withColumns(blank), ["user_id"], ["ts", "event_id"], inputs, carrying, lambda: None, out)
    carry = fd.final_state(early, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("mean").alias("mean0"), F.col("weight").alias("weight0"), F.col("n").alias("n0"))
    late = e.where("late").join(carry, "user_id", "left").withColumn("n0", F.coalesce("n0", F.lit(-1).cast("long")))
    rest = fd.fold(late, ["user_id"], ["ts", "event_id"], inputs, carrying, lambda: None, out)
    return picked(early.unionByName(rest), "y")


@query("streaming_ewma", _ewma_sql(0.1, column="value"))
def _(spark, d):
    schema = tables.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(d)
    folded = keyed.fold_stream(stream, "user_id", ["ts", "event_id"], ["value"], fd.ewma_step(alpha=0.1), fd.ewma_start(), "y double")
    return picked(keyed.drain(folded), "y")


# ---- stream synchronisation --------------------------------------------------------------------------

_LOCAL = "l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase')"
_SEC = "s AS (SELECT event_id AS sid, ts AS sts, value AS sv FROM events WHERE event_type = 'error')"


def _local(spark, d) -> DataFrame:
    return tables.table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "ts")


def _errors(spark, d, **how) -> sy.Secondary:
    s = tables.table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("sid"), F.col("ts").alias("sts"), F.col("value").alias("sv"))
    return sy.Secondary("err", s, ("sid", "sv"), time="sts", order=("sid",), **how)


@query("sync_asof_ffill", f"WITH {_LOCAL}, {_SEC} SELECT event_id, sid, sv FROM l ASOF LEFT JOIN s ON l.ts > s.sts")
def _(spark, d):
    return sy.synchronise(_local(spark, d), [_errors(spark, d)]).select("event_id", "err.sid", "err.sv")


_NEW = "CASE WHEN sid IS DISTINCT FROM lag(sid) OVER (ORDER BY ts, event_id) THEN {} END"


@query("sync_asof_nofill", f"WITH {_LOCAL}, {_SEC}, m AS (SELECT * FROM l ASOF LEFT JOIN s ON l.ts > s.sts) SELECT event_id, {_NEW.format('sid')} AS sid, {_NEW.format('sv')} AS sv FROM m")
def _(spark, d):
    return sy.synchronise(_local(spark, d), [_errors(spark, d, ffill=False)]).select("event_id", "err.sid", "err.sv")


_THREE = "SELECT *, lag(sid) OVER (ORDER BY sts, sid) AS s2, lag(sid, 2) OVER (ORDER BY sts, sid) AS s3 FROM s"


@query("sync_buffered", f"WITH {_LOCAL}, {_SEC}, t AS ({_THREE}), m AS (SELECT * FROM l ASOF LEFT JOIN t ON l.ts > t.sts) SELECT event_id, {_NEW.format('s3')} AS b0, {_NEW.format('s2')} AS b1, {_NEW.format('sid')} AS b2 FROM m")
def _(spark, d):
    got = sy.synchronise(_local(spark, d), [_errors(spark, d, ffill=False, buffer=3)])
    return got.select("event_id", *[F.get("err", F.lit(k))["sid"].alias(f"b{k}") for k in range(3)])


_DAILY = "g AS (SELECT date_trunc('day', ts) AS day, avg(value) AS mean FROM events GROUP BY 1)"


def _daily(spark, d, **how) -> sy.Secondary:
    g = tables.table(spark, d, "events").groupBy(scalar.floor_datetime(F.col("ts")).alias("day")).agg(F.avg("value").alias("mean"))
    return sy.Secondary("daily", g, ("mean",), time="day", freq="day", **how)


@query("sync_freq_day", f"WITH {_DAILY} SELECT event_id, round(mean, 6) AS mean FROM (SELECT event_id, date_trunc('day', ts) AS cut FROM events) e ASOF LEFT JOIN g ON e.cut > g.day")
def _(spark, d):
    e = tables.table(spark, d, "events").select("event_id", "ts")
    return sy.synchronise(e, [_daily(spark, d)]).select("event_id", r6("daily.mean").alias("mean"))


@query("sync_multi", f"WITH {_LOCAL}, {_SEC}, {_DAILY}, m AS (SELECT *, date_trunc('day', ts) AS cut FROM l ASOF LEFT JOIN s ON l.ts > s.sts) SELECT event_id, sid, round(mean, 6) AS mean FROM m ASOF LEFT JOIN g ON m.cut > g.day")
def _(spark, d):
    got = sy.synchronise(_local(spark, d), [_errors(spark, d), _daily(spark, d)])
    return got.select("event_id", "err.sid", r6("daily.mean").alias("mean"))


@query("sync_by_key", "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT event_id AS sid, user_id, ts AS sts FROM events WHERE event_type = 'view') SELECT event_id, sid FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts > s.sts")
def _(spark, d):
    e = tables.table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("sid"), F.col("ts").alias("sts"))
    local = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return sy.synchronise(local, [sy.Secondary("view", views, ("sid",), time="sts", order=("sid",), key=("user_id",))]).select("event_id", "view.sid")


# ---- events, resets, machines ---------------------------------------------------------------------------


@query("update_on_event", f"WITH {E}, m AS (SELECT event_id, sum(value) OVER ({U}) AS s FROM e WHERE event_type = 'purchase') SELECT event_id, round(coalesce(last_value(s IGNORE NULLS) OVER ({U}), -999), 6) AS y FROM e LEFT JOIN m USING (event_id)")
def _(spark, d):
    module = lambda df, s: df.withColumn("y", s.cumulative(v()))
    return picked(ev.update_on_event(tables.events(spark, d), S, F.col("event_type") == "purchase", module, "y", -999.0), "y")


@query("update_on_event_output_only", f"WITH {E}, m AS (SELECT *, CASE WHEN event_type = 'purchase' THEN sum(value) OVER ({U}) END AS s FROM e) SELECT event_id, round(coalesce(last_value(s IGNORE NULLS) OVER ({U}), -999), 6) AS y FROM m")
def _(spark, d):
    e = tables.events(spark, d).withColumn("s", S.cumulative(v()))
    return picked(ev.cache_on_event(e, S, F.col("event_type") == "purchase", F.col("s"), "y", -999.0), "y")


@query("scan_with_reset", f"WITH {E}, g AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e) SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS y FROM g")
def _(spark, d):
    module = lambda df, s: df.withColumn("y", s.cumulative(v()))
    return picked(ev.scan_with_reset(tables.events(spark, d), S, F.col("event_type") == "error", module), "y")


@query("volume_breakout", f"WITH {E}, m AS (SELECT *, CASE WHEN value > 80 THEN avg(value) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS s FROM e) SELECT event_id, round(coalesce(last_value(s IGNORE NULLS) OVER ({U}), 0), 6) AS y FROM m")
def _(spark, d):
    e = tables.events(spark, d).withColumn("s", S.rolling_mean(v(), 20))
    return picked(ev.cache_on_event(e, S, v() > 80, F.col("s"), "y", 0.0), "y")


@query("compose_pipeline", f"WITH {E}, a AS (SELECT *, last_value(x IGNORE NULLS) OVER ({U}) AS f FROM e), b AS (SELECT *, avg(f) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM a) SELECT event_id, round(m - lag(m) OVER ({W}), 6) AS y FROM b")
def _(spark, d):
    steps = (lambda df: df.withColumn("f", S.ffill(x())), lambda df: df.withColumn("m", S.rolling_mean(F.col("f"), 5)), lambda df: df.withColumn("y", S.diff(F.col("m"))))
    return picked(ev.compose(tables.events(spark, d), *steps), "y")


_PATTERNS = {"half": lambda s: {"x": s["x"] / 2, "influence": s["x"] - 10}, "raised": lambda s: {"y": s["x"] + 1}}


def _composed(strategy: str) -> dict[str, Column]:
    got = ev.composed(_PATTERNS, {"x": v()}, strategy)
    return {"half": r6(got["half"]["x"]), "raised": r6(got["raised"]["y"])}


over_events("compose_chained", lambda: _composed("pipeline"), "round(value / 2, 6) AS half, round(value / 2 + 1, 6) AS raised")
over_events("compose_parallel", lambda: _composed("parallel"), "round(value / 2, 6) AS half, round(value + 1, 6) AS raised")
over_events("compose_hierarchical", lambda: _composed("hierarchical"), "round(value / 2, 6) AS half, round(value - 9, 6) AS raised")


def _levels() -> dict[str, Column]:
    def broken(s):
        raise ValueError("no such input")

    states = {"stock": lambda s: {"x": s["x"] + 10}, "sector": lambda s: {"x": s["x"] * 2, "z": s["x"]}, "market": lambda s: {"x": s["x"], "z": s["x"] / 2}, "broken": broken}
    got = ev.hierarchical_machine(states, {"x": v()}, {"stock": ["sector"], "sector": ["market"], "broken": ["market"]})
    return {"market": r6(got["market"]["x"]), "sector": r6(got["sector"]["x"]), "sector_z": r6(got["sector"]["z"]), "stock": r6(got["stock"]["x"]), "status": got["broken"]["status"], "error": got["broken"]["error"]}


over_events("hierarchical_machine", _levels, "round(value, 6) AS market, round(1.9 * value, 6) AS sector, round(0.95 * value, 6) AS sector_z, round(0.9 * (0.9 * (value + 10) + 0.1 * value) + 0.1 * (1.9 * value), 6) AS stock, 'failed' AS status, 'no such input' AS error")
over_events("tree_struct", lambda: {"t": F.to_json(scalar.tree_struct(scalar.tree_map(lambda a, b: (a + b).cast("long"), {"p": [F.col("event_id"), F.col("user_id")], "q": F.col("event_id")}, {"p": [F.lit(1), F.lit(2)], "q": F.lit(3)})))}, """'{"p":{"_0":' || (event_id + 1) || ',"_1":' || (user_id + 2) || '},"q":' || (event_id + 3) || '}' AS t""")


def _folded(spark, d, inputs, machine, outputs, **how) -> DataFrame:
    step, start = machine
    return fd.fold(tables.events(spark, d), ["user_id"], ["ts", "event_id"], inputs, step, start, outputs, **how)


@query("state_machine", recursive({"s": ("'calm'", "CASE WHEN f.s = 'calm' AND r.value > 80 THEN 'hot' WHEN f.s = 'hot' AND r.value < 30 THEN 'calm' ELSE f.s END"), "y": ("0", "CASE WHEN f.s = 'calm' THEN r.value ELSE 2 * r.value END")}, "f.y AS y, f.s AS state", kind={"s": "VARCHAR"}))
def _(spark, d):
    machine = fd.state_machine({"calm": lambda a: a, "hot": lambda a: 2 * a}, [("calm", "hot", lambda a: a > 80), ("hot", "calm", lambda a: a < 30)], "calm")
    return _folded(spark, d, ["value"], machine, "y double, state string").select("event_id", "y", "state")


@query("state_change", recursive({"y": ("0", "CASE WHEN f.l IS NULL OR abs(r.value - f.l) > 20 THEN 1 ELSE 0 END"), "l": ("NULL", "CASE WHEN f.l IS NULL OR abs(r.value - f.l) > 20 THEN r.value ELSE f.l END")}, "f.y = 1 AS y"))
def _(spark, d):
    return _folded(spark, d, ["value"], fd.change_detector(20.0), "y boolean").select("event_id", "y")


# ---- memories ----------------------------------------------------------------------------------------------


@query("downsample_buffer", f"WITH {E}, r AS (SELECT *, row_number() OVER ({W}) AS i FROM e), k AS (SELECT event_id, value AS b1, lag(value, 1, 0) OVER ({W}) AS b0 FROM r WHERE i % 2 = 0) SELECT event_id, last_value(b0 IGNORE NULLS) OVER ({U}) AS b0, last_value(b1 IGNORE NULLS) OVER ({U}) AS b1 FROM e LEFT JOIN k USING (event_id)")
def _(spark, d):
    got = mem.downsampled(tables.events(spark, d), S, "value", 4, 2, "b")
    return got.select("event_id", F.get("b", F.lit(0)).alias("b0"), F.get("b", F.lit(1)).alias("b1"))


@query("cms_sketch", "WITH i AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) * 10 AS item FROM events), h AS (SELECT * FROM (VALUES (0, 31, 17), (1, 37, 23), (2, 41, 29), (3, 43, 31)) t(h, a, b)), p AS (SELECT user_id, item, h, (a * item + b) % 1024 AS bucket FROM i CROSS JOIN h), c AS (SELECT user_id, h, bucket, count(*) AS n FROM p GROUP BY ALL) SELECT user_id, item, min(n) AS estimate FROM (SELECT DISTINCT * FROM p) JOIN c USING (user_id, h, bucket) GROUP BY user_id, item")
def _(spark, d):
    cents = F.round(v() * 100).cast("long") / 100
    return mem.sketch(tables.events(spark, d), "user_id", F.round(cents * 1000) / 1000 + 1e-7)


_Q = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


@query("buffer_quantiles", f"WITH {E}, r AS (SELECT *, row_number() OVER ({W}) AS i FROM e), q AS (SELECT a.event_id, {', '.join(f'quantile_cont(coalesce(b.value, 0), {p}) AS {n}_' for n, p in _Q.items())} FROM r a CROSS JOIN range(0, 20) g(k) LEFT JOIN r b ON b.user_id = a.user_id AND b.i = a.i - g.k WHERE a.i % 10 = 0 GROUP BY a.event_id) SELECT event_id, {', '.join(f'round(last_value({n}_ IGNORE NULLS) OVER ({U}), 6) AS {n}' for n in _Q)} FROM e LEFT JOIN q USING (event_id)")
def _(spark, d):
    return picked(mem.quantiles(tables.events(spark, d), S, "value", 20), "q10", "q25", "q50", "q75", "q90")


@query("hierarchical_buffer", f"WITH {E}, r AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM e), m AS (SELECT a.event_id, sum(b.value * pow(0.9, (a.i - b.i) / 5)) / sum(pow(0.9, (a.i - b.i) / 5)) AS me FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i AND b.i % 5 = 0 WHERE a.i % 5 = 0 GROUP BY a.event_id), l AS (SELECT event_id, quantile_cont(value, 0.5) OVER ({U}) AS q FROM r WHERE i % 50 = 0) SELECT event_id, round(value, 6) AS recent, round(last_value(me IGNORE NULLS) OVER ({U}), 6) AS medium_ewma, round(coalesce(q, 0), 6) AS long_median FROM r LEFT JOIN m USING (event_id) LEFT JOIN l USING (event_id)")
def _(spark, d):
    return picked(mem.hierarchical(tables.events(spark, d), S, "value"), "recent", "medium_ewma", "long_median")


# ---- filters, learners, feedback ---------------------------------------------------------------------------------


@query("arma", recursive({"y": ("0", "r.value / 100 + 0.3 * f.e + 0.2 * f.y1 + 0.5 * f.y"), "y1": ("0", "f.y"), "e": ("0", "r.value / 100")}, "f.y AS y"))
def _(spark, d):
    step, start = fd.arma([0.2, 0.5], [0.3])
    e = tables.events(spark, d).withColumn("eps", v() / 100)
    return fd.fold(e, ["user_id"], ["ts", "event_id"], ["eps"], step, start, "y double").select("event_id", "y")


over_events("ma_filter", lambda: {"y": r6(v() + 0.3 * S.lag(v(), 2, 0.0) - 0.2 * S.lag(v(), 1, 0.0))}, f"round(value + 0.3 * lag(value, 2, 0) OVER ({W}) - 0.2 * lag(value, 1, 0) OVER ({W}), 6) AS y")
_GUESS = "(0.5 * f.error + 0.3 * f.f2 + 0.2 * (r.value / 100))"


@query("snarimax_features", recursive({"guess": ("0", _GUESS), "error": ("0", f"r.value / 100 - {_GUESS}"), "f0": ("0", "f.error"), "f1": ("0", "f.f2"), "f2": ("0", "r.value / 100")}, "f.guess AS guess, f.error AS error, f.f0 AS f0, f.f1 AS f1, f.f2 AS f2"))
def _(spark, d):
    machine = fd.snarimax_features(2, 1, lambda z: 0.5 * z[0] + 0.3 * z[1] + 0.2 * z[2])
    e = tables.events(spark, d).withColumn("y", v() / 100)
    return fd.fold(e, ["user_id"], ["ts", "event_id"], ["y"], *machine, "guess double, error double, f0 double, f1 double, f2 double").drop("user_id", "ts")


def _newton_sql(inputs: list[str], target: str, rate: float, more: dict[str, tuple[str, str]] | None = None, eps: float = 1e-5) -> dict[str, tuple[str, str]]:
    """State of an online regression by Newton steps, the same operations in the same order; p is the prediction."""
    x, k = [*inputs, "1.0e0"], range(len(inputs) + 1)
    name = lambda i, j: f"f.h{min(i, j)}{max(i, j)}"
    guess = dot_sql([f"f.w{i}" for i in k], x)
    g = [f"(-2.0e0 * ({target} - {guess}) * {v_})" for v_ in x]
    hg = [dot_sql([name(i, j) for j in k], g) for i in k]
    scale = f"(1.0e0 + {dot_sql(g, hg)})"
    h = {(i, j): f"({name(i, j)} - {hg[i]} * {hg[j]} / {scale})" for i in k for j in k if i <= j}
    state = {"p": ("0", guess)} | {key: (a, b.replace("{guess}", guess)) for key, (a, b) in (more or {}).items()}
    state |= {f"h{i}{j}": (dbl(1 / eps) if i == j else "0", e) for (i, j), e in h.items()}
    return state | {f"w{i}": ("0", f"f.w{i} + -{dbl(rate)} * {dot_sql([h[min(i, j), max(i, j)] for j in k], g)}") for i in k}


_Y = "(r.value / 100)"


@query("snarimax_forecast", recursive(_newton_sql(["f.e", "f.y1", "f.y"], _Y, 0.3, {"e": ("0", f"{_Y} - {{guess}}"), "y1": ("0", "f.y"), "y": ("0", _Y)}), "f.p AS guess, f.e AS error"))
def _(spark, d):
    step, start = fd.snarimax(2, 1, 0, fd.newton(0.3))
    e = tables.events(spark, d).withColumn("y", v() / 100)
    return fd.fold(e, ["user_id"], ["ts", "event_id"], ["y"], step, start, "guess double, error double").select("event_id", "guess", "error")


_PAIR = {"a": f"coalesce(lag(value) OVER ({W}), 0) / 100", "b": "value / 100"}


def _pairs(spark, d) -> DataFrame:
    return tables.events(spark, d).withColumn("a", F.coalesce(S.lag(v()), F.lit(0.0)) / 100).withColumn("b", v() / 100)


def _with_pair(sql: str) -> str:
    return sql.replace("SELECT *, row_number()", f"SELECT *, {_PAIR['a']} AS a, row_number()", 1)


def _linreg_sql(rate: float, projected: bool = False) -> str:
    low, high = ("greatest(least(", ", 0.4), -0.4)") if projected else ("", "")
    miss = "(r.value / 100 - (f.w * r.a + f.c))"
    state = {"p": ("0", "f.w * r.a + f.c"), "w": ("0", f"{low}f.w + -{dbl(rate)} * (-2.0e0 * {miss} * r.a){high}"), "c": ("0", f"{low}f.c + -{dbl(rate)} * (-2.0e0 * {miss}){high}")}
    return _with_pair(recursive(state, "f.p AS guess, f.w AS w0, f.c AS w1"))


_FIT = "guess double, loss double, w0 double, w1 double"


def _fitted(spark, d, optimiser, **how) -> DataFrame:
    machine = fd.online_regression(1, optimiser, **how)
    return fd.fold(_pairs(spark, d), ["user_id"], ["ts", "event_id"], ["a", "b"], *machine, _FIT).select("event_id", "guess", "w0", "w1")


@query("online_linreg_sgd", _linreg_sql(0.05))
def _(spark, d):
    return _fitted(spark, d, fd.sgd(0.05))


@query("online_optimizer_projected", _linreg_sql(0.05, True))
def _(spark, d):
    return _fitted(spark, d, fd.sgd(0.05), project=lambda w: [max(min(u, 0.4), -0.4) for u in w])


@query("online_linreg_newton", _with_pair(recursive(_newton_sql(["r.a"], "(r.value / 100)", 0.5), "f.p AS guess, f.w0 AS w0, f.w1 AS w1")))
def _(spark, d):
    return _fitted(spark, d, fd.newton(0.5))


def _optimiser_sql(kind: str) -> str:
    """One weight (the constant is frozen) under another optimiser."""
    g = "(-2.0e0 * (r.value / 100 - (f.w0 * r.a + f.w1)) * r.a)"
    if kind == "adam":
        m, s_ = f"(0.9 * f.m + {dbl(1 - 0.9)} * {g})", f"(0.999 * f.s + {dbl(1 - 0.999)} * {g} * {g})"
        state = {"m": ("0", m), "s": ("0", s_), "w0": ("0", f"f.w0 + -0.05 * ({m} / (1 - pow(0.9e0, r.i))) / (sqrt({s_} / (1 - pow(0.999e0, r.i))) + 1e-8)")}
    else:
        s_ = f"(f.s + {g} * {g})" if kind == "adagrad" else f"(0.9 * f.s + {dbl(1 - 0.9)} * {g} * {g})"
        state = {"s": ("0.1" if kind == "adagrad" else "0", s_), "w0": ("0", f"f.w0 + -0.05 * {g} / sqrt({s_} + {'1e-7' if kind == 'adagrad' else '1e-8'})")}
    return _with_pair(recursive({"p": ("0", "f.w0 * r.a + f.w1"), **state, "w1": ("0", "f.w1")}, "round(f.p, 6) AS guess, round(f.w0, 6) AS w0, f.w1 AS w1"))


for _name, _make in (("adagrad", fd.adagrad), ("rmsprop", fd.rmsprop), ("adam", fd.adam)):
    query(f"online_linreg_{_name}", _optimiser_sql(_name))(lambda spark, d, make=_make: _fitted(spark, d, make(0.05), frozen=(1,)).select("event_id", r6("guess").alias("guess"), r6("w0").alias("w0"), "w1"))


_MISS = "(f.w0 * r.a + f.w1 - r.value / 100)"


@query("func_optimizer", _with_pair(recursive({"loss": ("0", f"{_MISS} * {_MISS}"), "guess": ("0", "f.w0 * r.a + f.w1"), "w0": ("0", f"f.w0 + -0.05 * (2.0e0 * {_MISS} * r.a)"), "w1": ("0.1", "f.w1")}, "f.loss AS loss, f.guess AS guess, f.w0 AS w0, f.w1 AS w1")))
def _(spark, d):
    def loss(params, a, b):
        guess = params[0] * a + params[1]
        return (guess - b) * (guess - b), guess

    machine = fd.func_optimiser(loss, [0.0, 0.1], fd.sgd(0.05), trainable=lambda k: k == 0)
    return fd.fold(_pairs(spark, d), ["user_id"], ["ts", "event_id"], ["a", "b"], *machine, "loss double, guess double, w0 double, w1 double").drop("user_id", "ts")


@query("func_optimizer_tanh", _with_pair(recursive({"w": ("0.5", "f.w - 0.1 * (2 * (tanh(f.w * r.a) - r.value / 100) * (1 - tanh(f.w * r.a) * tanh(f.w * r.a)) * r.a)")}, "round(f.w, 6) AS w")))
def _(spark, d):
    machine = fd.func_optimiser(lambda p, a, b: ((p[0] * a).tanh() - b) ** 2, [0.5], fd.sgd(0.1))
    got = fd.fold(_pairs(spark, d), ["user_id"], ["ts", "event_id"], ["a", "b"], *machine, "loss double, w double")
    return picked(got, "w")


def _mean_state(name: str, c: str, alpha: float, when: str = "TRUE") -> dict[str, tuple[str, str]]:
    """An adjusted exponential mean of c, which is never missing, as state: the operations of the fold."""
    com = 1 / alpha - 1
    m, w = f"f.{name}", f"f.{name}_w"
    old = f"(CASE WHEN {m} IS NULL THEN 0.0e0 ELSE {w} * {dbl(com / (1 + com))} END)"
    mean = f"(CASE WHEN NOT ({when}) THEN {m} WHEN {m} IS NULL THEN {c} ELSE ({old} * {m} + {c}) / ({old} + 1.0e0) END)"
    return {name: ("NULL", mean), f"{name}_w": ("1", f"CASE WHEN {when} THEN {old} + 1.0e0 ELSE {w} END")}


def _predictor_sql(parts: list[tuple[str, float, float]]) -> tuple[dict, str]:
    """(states of the parts' means, their mixed output)"""
    means: dict = {}
    for k, (c, alpha, _) in enumerate(parts):
        means |= _mean_state(f"m{k}", c, alpha)
    return means, "((" + " + ".join(f"{means[f'm{k}'][1]} * {dbl(factor)}" for k, (_, _, factor) in enumerate(parts)) + f") / {len(parts)})"


_ENSEMBLE, _OUT = _predictor_sql([("r.a", 0.2, 1.05), ("(r.event_id % 97 + 0.0e0)", 0.15, 0.001)])


@query("ensemble_predictor", _with_pair(recursive({**_ENSEMBLE, "y": ("0", f"f.s * {_OUT}"), "s": ("1", f"f.s + -0.01 * (2 * (f.s * {_OUT} - r.value / 100) * {_OUT})")}, "f.y AS y, f.s AS scale, f.m0 * 1.05e0 AS price, f.m1 * 0.001e0 AS volume")))
def _(spark, d):
    machine = fd.predictor([(0.2, 1.05), (0.15, 0.001)], 0.01)
    e = _pairs(spark, d).withColumn("n", (F.col("event_id") % 97).cast("double"))
    return fd.fold(e, ["user_id"], ["ts", "event_id"], ["a", "n", "b"], *machine, "y double, scale double, price double, volume double").drop("user_id", "ts")


_ADAPTIVE, _ADAPTED = _predictor_sql([("(r.value / 100)", 0.1, 1.1)])
_SLOPE = f"(2 * (f.s * {_ADAPTED} - r.value / 100) * {_ADAPTED})"
_M1, _M2 = f"(0.9 * f.g1 + {dbl(1 - 0.9)} * {_SLOPE})", f"(0.999 * f.g2 + {dbl(1 - 0.999)} * {_SLOPE} * {_SLOPE})"


@query("adaptive_predictor", recursive({**_ADAPTIVE, "y": ("0", f"f.s * {_ADAPTED}"), "g1": ("0", _M1), "g2": ("0", _M2), "s": ("1", f"f.s - 0.001 * ({_M1} / (1 - pow(0.9e0, r.i))) / (sqrt({_M2} / (1 - pow(0.999e0, r.i))) + 1e-8)")}, "round(f.y, 6) AS y, round(f.s, 6) AS scale"))
def _(spark, d):
    e = tables.events(spark, d).withColumn("b", v() / 100)
    got = fd.fold(e, ["user_id"], ["ts", "event_id"], ["b", "b"], *fd.predictor([(0.1, 1.1)], 0.0, fd.adam(0.001)), "y double, scale double, part double")
    return picked(got, "y", "scale")


@query("nested_unroll", f"WITH {E}, b AS (SELECT event_id, {', '.join(f'lag(value, {3 - k}, 0.0) OVER ({W}) AS b{k}' for k in range(4))} FROM e) SELECT event_id, (0.875 * ((0.75 * ((0.5 * b0 + b1) / 1.5) + b2) / 1.75) + b3) / 1.875 AS y FROM b")
def _(spark, d):
    inner = fd.nested(fd.ewma_step(alpha=0.5), fd.ewma_start())
    e = tables.events(spark, d).withColumn("buf", S.buffer(v(), 4, 0.0))
    got = fd.fold(e, ["user_id"], ["ts", "event_id"], ["buf"], inner, lambda: None, "ys array<double>")
    return got.select("event_id", F.get("ys", F.lit(3)).alias("y"))


@query("piped_folds", recursive({**_mean_state("m", "r.value", 0.2), "z": ("0", f"{_mean_state('m', 'r.value', 0.2)['m'][1]} + 0.5 * f.z")}, "f.z AS y"))
def _(spark, d):
    machine = fd.piped((fd.ewma_step(alpha=0.2), fd.ewma_start()), fd.arma([0.5], []))
    return _folded(spark, d, ["value"], machine, "y double").select("event_id", "y")


_SCALE = {"y": ("0", "f.s * r.a"), "s": ("1", "f.s + -0.1 * (2 * (f.s * r.a - r.value / 100) * r.a)")}


@query("streaming_optimizer_scale", _with_pair(recursive(_SCALE, "f.y AS y, f.s AS scale")))
def _(spark, d):
    step, start = fd.scale_optimiser(0.1)
    return fd.fold(_pairs(spark, d), ["user_id"], ["ts", "event_id"], ["a", "b"], step, start, "y double, scale double").select("event_id", "y", "scale")


def _scanned(spark, d) -> DataFrame:
    """Mean loss of every rate: the grid multiplies the keys, so the folds run side by side."""

    rates = F.explode(F.array(F.lit(0.01), F.lit(0.1), F.lit(0.5))).alias("rate")
    grid = _pairs(spark, d).select("*", rates)

    def step(state, row):
        s, out, y, rate = state, float(row[0]), float(row[1]), float(row[2])
        return ((s * out - y) ** 2,), s - rate * 2 * (s * out - y) * out

    losses = fd.fold(grid, ["user_id", "rate"], ["ts", "event_id"], ["a", "b", "rate"], step, lambda: 1.0, "loss double")
    return losses.groupBy("rate").agg(F.avg("loss").alias("loss"))


_GRID = f"WITH RECURSIVE {E}, r AS (SELECT *, {_PAIR['a']} AS a, row_number() OVER ({W}) AS i FROM e), f AS (SELECT user_id, rate, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS l, CAST(1 AS DOUBLE) AS s FROM (SELECT DISTINCT user_id FROM e) CROSS JOIN (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) g(rate) UNION ALL SELECT r.user_id, f.rate, r.i, CAST(pow(f.s * r.a - r.value / 100, 2) AS DOUBLE), CAST(f.s - f.rate * 2 * (f.s * r.a - r.value / 100) * r.a AS DOUBLE) FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1), t AS (SELECT rate, avg(l) AS loss FROM f WHERE i > 0 GROUP BY rate) "


@query("hparam_scan", _GRID + "SELECT rate, round(loss, 6) AS loss FROM t")
def _(spark, d):
    return picked(_scanned(spark, d), "loss", keep="rate")


@query("best_hparam", _GRID + "SELECT arg_min(rate, loss) AS rate, round(min(loss), 6) AS loss FROM t")
def _(spark, d):
    return _scanned(spark, d).agg(F.min_by("rate", "loss").alias("rate"), r6(F.min("loss")).alias("loss"))


_FEED = {
    "rw": ("NULL", "CASE WHEN f.a IS NULL THEN NULL ELSE f.a * (0.5 * (r.value / 100 + f.a)) END"),
    "o": ("NULL", "CASE WHEN f.a IS NULL THEN r.value / 100 ELSE 0.5 * (r.value / 100 + f.a) END"),
    "a": ("NULL", "CASE WHEN f.a IS NULL THEN r.value / 100 + 1 ELSE 0.5 * (r.value / 100 + f.a) + 1 END"),
}


def _feedback(spark, d, skip_first: bool) -> DataFrame:
    def env(action, raw):
        obs = 0.5 * (raw + action)
        return action * obs, obs

    step, start = fd.feedback(lambda obs: obs + 1, env)
    e = tables.events(spark, d).withColumn("raw", v() / 100)
    return fd.fold(e, ["user_id"], ["ts", "event_id"], ["raw"], step, start, "reward double, obs double, action double", skip_first=skip_first)


@query("gym_feedback", recursive(_FEED, "f.rw AS reward, f.o AS obs, f.a AS action", where="WHERE r.i > 1"))
def _(spark, d):
    return _feedback(spark, d, True).drop("user_id", "ts")


@query("gym_until_done", f"WITH g AS ({recursive(_FEED, 'r.user_id, r.ts, f.rw AS reward, f.o AS obs, coalesce(f.o > 1.6, FALSE) AND r.i > 1 AS done')}) SELECT event_id, reward, obs, done FROM (SELECT *, coalesce(sum(CAST(done AS INT)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM g) WHERE n = 0")
def _(spark, d):
    def env(action, raw):
        obs = 0.5 * (raw + action)
        return action * obs, obs, obs > 1.6

    env.ends = True
    e = tables.events(spark, d).withColumn("raw", v() / 100)
    got = fd.fold(e, ["user_id"], ["ts", "event_id"], ["raw"], *fd.feedback(lambda obs: obs + 1, env), "reward double, obs double, action double, done boolean", done="done")
    return got.select("event_id", "reward", "obs", "done")


_NOISE = "((r.event_id % 13 - 6) / 100)"
_TARGET = f"((CASE WHEN r.i <= 20 THEN 1.0e0 ELSE -1.0e0 END) * (0.7 * r.a + 0.1) + {_NOISE})"
_GAP = f"({_TARGET} - (f.w * r.a + f.c))"
_GAME = {
    "p": ("0", "f.w * r.a + f.c"), "t": ("0", _TARGET), "rw": ("0", "f.late"), "late": ("0", f"-({_GAP} * {_GAP})"), "regret": ("0", f"f.regret + ({_GAP} * {_GAP} - {_NOISE} * {_NOISE})"),
    "w": ("0", f"f.w + -0.05 * (-2.0e0 * {_GAP} * r.a)"), "c": ("0", f"f.c + -0.05 * (-2.0e0 * {_GAP})"),
}


@query("gym_linreg_regret", _with_pair(recursive(_GAME, "f.p AS guess, f.t AS target, f.rw AS reward, f.regret AS regret")))
def _(spark, d):
    """A learner in a regression whose sign turns after 20 rows; rewards come a row late."""
    machine = fd.regression_game(fd.RegressionEnv(0.7, 0.1, 20), fd.sgd(0.05))
    e = _pairs(spark, d).withColumn("noise", (F.col("event_id") % 13 - 6) / 100)
    return fd.fold(e, ["user_id"], ["ts", "event_id"], ["a", "noise"], *machine, "guess double, target double, reward double, regret double").drop("user_id", "ts")


# ---- indicators ------------------------------------------------------------------------------------------------------


@query("bollinger")
def _(spark, d):
    return picked(ix.bollinger(tables.events(spark, d), S, "value"), "middle", "upper", "lower", "position")


def _weighted(c: str, alpha: float) -> str:
    return f"sum(b.{c} * pow({1 - alpha!r}, a.i - b.i)) / sum(pow({1 - alpha!r}, a.i - b.i))"


ORACLE_SQL["bollinger"] = f"WITH {E}, r AS (SELECT *, row_number() OVER ({W}) AS i, CASE WHEN count(value) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 1 THEN stddev_pop(value) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) ELSE 0 END AS sd FROM e), m AS (SELECT a.event_id, any_value(a.value) AS value, any_value(a.sd) AS sd, {_weighted('value', 2 / 21)} AS mid FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id) SELECT event_id, round(mid, 6) AS middle, round(mid + 2 * sd, 6) AS upper, round(mid - 2 * sd, 6) AS lower, round(CASE WHEN 4 * sd > 1e-8 THEN (value - (mid - 2 * sd)) / (4 * sd) ELSE 0.5 END, 6) AS position FROM m"


@query("macd", f"WITH {E}, r AS (SELECT *, row_number() OVER ({W}) AS i FROM e), m AS (SELECT a.event_id, a.user_id, a.i, {_weighted('value', 2 / 13)} - {_weighted('value', 2 / 27)} AS macd FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id, a.user_id, a.i), s AS (SELECT a.event_id, any_value(a.macd) AS macd, {_weighted('macd', 2 / 10)} AS signal FROM m a JOIN m b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id) SELECT event_id, round(macd, 6) AS macd, round(signal, 6) AS signal, round(macd - signal, 6) AS histogram FROM s")
def _(spark, d):
    return picked(ix.macd(tables.events(spark, d), S, "value"), "macd", "signal", "histogram")


def _signal_sql() -> str:
    state = {**_mean_state("fast", "r.value", 0.3), **_mean_state("slow", "r.value", 0.05), **_mean_state("v1", "r.value", 0.1), **_mean_state("v2", "(r.value * r.value)", 0.1)}
    return recursive(state, "round(tanh((f.fast - f.slow) / (sqrt(greatest(f.v2 - f.v1 * f.v1, 0)) + 1e-6)), 6) AS signal")


@query("signal_processor", _signal_sql())
def _(spark, d):
    return picked(ix.signal_processor(tables.events(spark, d), S, "value"), "signal")


_HIGH = f"sqrt(greatest(sum(o * o) OVER w / 50 - pow(sum(o) OVER w / 50, 2), 0))"
_REGIME = recursive({**_mean_state("fast", "r.value", 0.3, "r.vol > 25"), **_mean_state("slow", "r.value", 0.05, "NOT r.vol > 25")}, "round(r.vol, 6) AS volatility, CASE WHEN r.vol > 25 THEN 'high_vol' ELSE 'low_vol' END AS regime, round(CASE WHEN r.vol > 25 THEN f.fast ELSE f.slow END, 6) AS signal")


@query("regime_signal", _REGIME.replace("r AS (SELECT *, row_number()", f"o AS (SELECT *, value - first_value(value) OVER ({U}) AS o FROM e), r AS (SELECT *, {_HIGH} AS vol, row_number()", 1).replace("AS i FROM e)", f"AS i FROM o WINDOW w AS ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))", 1))
def _(spark, d):
    return ix.regime_signal(tables.events(spark, d), S, "value", 25.0).select("event_id", r6("volatility").alias("volatility"), "regime", r6("signal").alias("signal"))


@query("cumulative_returns", f"WITH {E}, g AS (SELECT *, value - 5 AS p, coalesce(sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM e), q AS (SELECT *, CASE WHEN p + 1e-8 > 0 THEN ln(p + 1e-8) END AS r FROM g) SELECT event_id, round(r, 6) AS return, round(sum(r) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative FROM q")
def _(spark, d):
    return picked(ix.cumulative_returns(tables.events(spark, d).withColumn("p", v() - 5), S, "p"), "return", "cumulative")


def _trading_sql() -> str:
    fast, slow = _mean_state("fast", "r.value", 2 / 13), _mean_state("slow", "r.value", 2 / 27)
    state = {**fast, **slow, **_mean_state("mid", "r.value", 2 / 21), **_mean_state("sig", f"({fast['fast'][1]} - {slow['slow'][1]})", 2 / 10)}
    sd = f"CASE WHEN count(value) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 1 THEN stddev_pop(value) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) ELSE 0 END AS sd"
    rows = recursive(state, "r.user_id, r.ts, r.value, r.sd, f.mid AS mid, f.fast - f.slow AS macd, f.fast - f.slow - f.sig AS hist").replace("SELECT *, row_number()", f"SELECT *, {sd}, row_number()", 1)
    return (
        f"WITH t AS ({rows}), b AS (SELECT *, CASE WHEN 4 * sd > 1e-8 THEN (value - (mid - 2 * sd)) / (4 * sd) ELSE 0.5 END AS pos, coalesce(last_value(CASE WHEN value > 80 THEN hist END IGNORE NULLS) OVER ({U}), 0) AS breakout FROM t), "
        "s AS (SELECT *, tanh(macd / 10) * (1 - pos) + 0.1 * sign(breakout) AS signal FROM b) "
        "SELECT event_id, round(sign(signal) * least(abs(signal), 1.0) * 0.02, 6) AS size, round(breakout, 6) AS breakout, round(pos, 6) AS position FROM s"
    )


@query("trading_system", _trading_sql())
def _(spark, d):
    e = ix.bollinger(tables.events(spark, d), S, "value")
    e = ix.macd(e.drop("middle", "upper", "lower"), S, "value")
    e = ev.cache_on_event(e, S, v() > 80, F.col("histogram"), "breakout", 0.0)
    signal = F.tanh(F.col("macd") / 10) * (1 - F.col("position")) + 0.1 * F.signum("breakout")
    return picked(e.withColumn("size", ix.position_size(signal)), "size", "breakout", "position")
