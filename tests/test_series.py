import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronofold.operators import events as ev
from chronofold.operators import fold as fd
from chronofold.operators import memory as mem
from chronofold.operators import series as ts
from chronofold.operators import sync as sy
from chronofold.sources import tables

S = ts.Series(("k",), ("t",))


def frame(spark, values):
    return spark.createDataFrame([("a", t, None if v is None else float(v)) for t, v in enumerate(values)], "k string, t int, x double")


def out(df, column="y"):
    return [r[column] for r in df.orderBy("t").collect()]


def near(a, b, tol=1e-6):
    assert len(a) == len(b)
    assert all(p is None and q is None or p is not None and q is not None and abs(p - q) < tol for p, q in zip(a, b)), (a, b)


def test_golden_lags_fills_changes(spark):
    df = frame(spark, [10, 11, 12])
    near(out(df.withColumn("y", S.lag(F.col("x")))), [None, 10, 11])
    near(out(df.withColumn("y", S.lag(F.col("x"), 2))), [None, None, 10])
    near(out(frame(spark, [90, 91, None, 85]).withColumn("y", S.ffill(F.col("x")))), [90, 91, 91, 85])
    near(out(S.pct_change(frame(spark, [None, 90, 91, None, 85]), "x", "y")), [None, None, 0.0111111, 0, -0.0659341])
    assert out(frame(spark, range(10)).withColumn("y", S.counter())) == list(range(1, 11))
    assert out(frame(spark, range(1, 8)).withColumn("y", S.buffer(F.col("x"), 5)))[-1] == [3, 4, 5, 6, 7]


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("ignore_na", [True, False])
@pytest.mark.parametrize("alpha", [0.05, 0.9])
def test_ewma_equals_pandas(spark, adjust, ignore_na, alpha):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(700)
    x[rng.random(700) < 0.2] = np.nan
    x[100:420] = np.nan  # a gap longer than a block at alpha 0.9
    df = frame(spark, [None if math.isnan(v) else v for v in x])
    want = pd.Series(x).ewm(alpha=alpha, adjust=adjust, ignore_na=ignore_na).mean()
    near(out(S.ewma(df, "x", "y", alpha=alpha, adjust=adjust, ignore_na=ignore_na)), [None if math.isnan(v) else v for v in want], 1e-9)
    step = fd.ewma_step(alpha=alpha, adjust=adjust, ignore_na=ignore_na)
    near(out(fd.fold(df, ["k"], ["t"], ["x"], step, fd.ewma_start(), "y double")), [None if math.isnan(v) else v for v in want], 1e-9)


def test_ewma_edges(spark):
    near(out(S.ewma(frame(spark, [None, 1, None, 3]), "x", "y", alpha=1.0)), [None, 1, 1, 3])
    near(out(S.ewma(frame(spark, [None, 1]), "x", "y", alpha=0.5, initial=3.0)), [3, (3 * 0.25 + 1) / 1.25])
    near(out(S.ewma(frame(spark, [1, 2, 3]), "x", "y", com=100, adjust="linear")), [1, 1.5, 2])
    near(out(S.ewmvar(frame(spark, [None, 1, 3]), "x", "y", alpha=0.5)), [0, 0, 8 / 9])
    with pytest.raises(ValueError):
        S.ewma(frame(spark, [1]), "x", "y", alpha=0.5, com=1.0)


def test_ohlc_resets_before_and_scan_resets_after(spark):
    df = frame(spark, [3, 5, None, 1, 4]).withColumn("r", F.col("t") == 3)
    rows = S.ohlc(df, "x", F.col("r")).orderBy("t").collect()
    assert [(r.open, r.high, r.low, r.close) for r in rows] == [(3, 3, 3, 3), (3, 5, 3, 5), (3, 5, 3, 5), (1, 1, 1, 1), (1, 4, 1, 4)]
    total = lambda d, s: d.withColumn("y", s.cumulative(F.coalesce("x", F.lit(0.0))))
    near(out(ev.scan_with_reset(df, S, F.col("r"), total)), [3, 8, 8, 9, 4])


def test_event_updates(spark):
    x = -1.6652094
    df = frame(spark, [x] * 10).withColumn("on", F.col("t").isin(3, 7))
    module = lambda d, s: d.withColumn("y", 2 * s.cumulative(F.col("x")))
    near(out(ev.update_on_event(df, S, F.col("on"), module, "y", -999.0)), [-999] * 3 + [2 * x] * 4 + [4 * x] * 3)
    df = frame(spark, [1, -1, -2, 2])
    near(out(ev.cache_on_event(df, S, F.col("x") > 0, F.col("x") + 1, "y")), [2, 2, 2, 3])


def test_masks(spark):
    df = spark.createDataFrame([("g", True, 1.0), ("g", True, None), ("g", False, 9.0), ("h", False, 1.0)], "g string, m boolean, x double")
    got = {r.g: (r.mean, r.std) for r in df.groupBy("g").agg(ts.mask_mean(F.col("m"), F.col("x")).alias("mean"), ts.mask_std(F.col("m"), F.col("x")).alias("std")).collect()}
    assert got == {"g": (0.5, 0.5), "h": (None, None)}
    y = {r.x: r.y for r in ts.mask_normalize(df, "g", F.col("m"), F.col("x"), "y").where("g = 'g'").collect()}
    assert y == {1.0: 2.0, None: 0.0, 9.0: 18.0}
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (float("-inf"),), (2.0,), (None,)], "x double").select(ts.fill_nan_inf(F.col("x"))).collect()] == [0, 0, 2, 0]


def test_feedback_and_stop(spark):
    df = frame(spark, range(10))
    step, start = fd.feedback(lambda obs: obs + 1, lambda a, raw: (a * (raw + a), raw + a))
    rewards = out(fd.fold(df, ["k"], ["t"], ["x"], step, start, "reward double, obs double, action double", skip_first=True), "reward")
    assert rewards == [2, 15, 54, 140, 300, 567, 980, 1584, 2430]
    three = fd.fold(df, ["k"], ["t"], ["x"], step, start, "reward double, obs double, action double", skip_first=True, stop=3)
    assert out(three, "reward") == [2, 15, 54]


def test_learners_reduce_loss(spark):
    rng = np.random.default_rng(0)
    rows = [("a", t, *map(float, x), float(x.sum())) for t, x in enumerate(rng.standard_normal((300, 3)))]
    df = spark.createDataFrame(rows, "k string, t int, x0 double, x1 double, x2 double, target double")
    for optimiser in (fd.sgd(0.05), fd.adagrad(0.5), fd.rmsprop(0.05), fd.adam(0.1), fd.newton(0.5)):
        step, start = fd.online_regression(3, optimiser)
        loss = out(fd.fold(df, ["k"], ["t"], ["x0", "x1", "x2", "target"], step, start, "g double, loss double, a double, b double, c double, d double"), "loss")
        assert np.mean(loss[-50:]) < 0.2 * np.mean(loss[:20])
    with pytest.raises(NotImplementedError):
        fd.snarimax(1, 1, 0, fd.sgd(0.1), d=1)


def test_sync_is_strict_and_buffers(spark):
    local = spark.sql("SELECT id AS event_id, timestamp_ntz'2000-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int),0,0) AS ts FROM range(60)")
    daily = spark.sql("SELECT id AS n, timestamp_ntz'2000-01-01 00:00:00' + make_interval(0,0,0,cast(id as int),0,0,0) AS ts FROM range(3)")
    held = [r.s.n if r.s else None for r in sy.synchronise(local, [sy.Secondary("s", daily, ("n",))]).orderBy("event_id").collect()]
    assert held == [None] + [0] * 24 + [1] * 24 + [2] * 11
    once = [r.s.n if r.s else None for r in sy.synchronise(local, [sy.Secondary("s", daily, ("n",), ffill=False)]).orderBy("event_id").collect()]
    assert [k for k, v in enumerate(once) if v is not None] == [1, 25, 49]
    cut = [r.s.n if r.s else None for r in sy.synchronise(local, [sy.Secondary("s", daily, ("n",), freq="d")]).orderBy("event_id").collect()]
    assert cut == [None] * 24 + [0] * 24 + [1] * 12
    many = [[e.n for e in r.s] if r.s else None for r in sy.synchronise(local, [sy.Secondary("s", daily, ("n",), buffer=2)]).orderBy("event_id").collect()]
    assert many[0] is None and many[1] == [None, 0] and many[30] == [0, 1]


def test_memory_bytes_and_grid(spark):
    assert mem.memory_bytes(500, "none", 8) == 4000 and mem.memory_bytes(500, "ewma") == 12
    with pytest.raises(ValueError):
        mem.memory_bytes(1, "zip")
    assert tables.grid(spark, 2, 2, 3).count() == 12
