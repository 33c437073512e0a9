"""State composition, generic optimisers, decoders, sources and memory helpers."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.functions import scalar
from chronofold.operators import events as ev
from chronofold.operators import fold as fd
from chronofold.operators import memory as mem
from chronofold.operators import series as ts
from chronofold.operators import sync as sy
from chronofold.sources import tables
from chronofold.streaming import keyed

S = ts.Series(("k",), ("t",))


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, t, None if v is None else float(v)) for t, v in enumerate(values)], "k string, t int, x double")


def out(df, column="y"):
    return [r[column] for r in df.orderBy("t").collect()]


def run(machine, rows):
    step, start = machine
    state, got = start(), []
    for row in rows:
        y, state = step(state, row)
        got.append(y)
    return got


def test_execution_order_and_levels():
    needs = {"c": ["b"], "b": ["a"], "x": ["y"], "y": ["x"]}
    order = ev.execution_order(["c", "b", "a"], needs)
    assert order == ["a", "b", "c"]
    assert sorted(ev.execution_order(["x", "y"], needs)) == ["x", "y"]
    assert ev.levels_of(["a", "b", "c"], needs) == {"a": 0, "b": 1, "c": 2}


def test_unknown_composition_raises():
    with pytest.raises(ValueError):
        ev.composed({}, {}, "sideways")


def test_failed_state_is_an_output(spark):
    def broken(s):
        raise KeyError("nothing")

    got = ev.hierarchical_machine({"ok": lambda s: {"x": s["x"]}, "bad": broken}, {"x": F.col("x")}, {"bad": ["ok"]})
    row = frame(spark, [2.0]).select(got["ok"]["x"].alias("x"), got["bad"]["status"].alias("status")).first()
    assert (row.x, row.status) == (2.0, "failed")


def test_reset_without_state(spark):
    df = frame(spark, [1, 2, 3, 4])
    module = lambda d, s: d.withColumn("y", s.cumulative(F.col("x")))
    assert out(ev.scan_with_reset(df, S, F.col("x") == 2, module)) == [1, 3, 3, 7]
    assert out(ev.scan_with_reset(df, S, F.col("x") == 2, module, preserve_state=False)) == [1, 3, 6, 10]


@pytest.mark.parametrize("ignore_na", [True, False])
def test_linear_ewma_ages_over_missing_rows(spark, ignore_na):
    """The recurrence as the survey gives it, row by row."""
    rng = np.random.default_rng(4)
    x = [None if rng.random() < 0.4 else float(rng.random()) for _ in range(200)]
    m, w, want = None, 1.0, []
    for v in x:
        if m is None:
            w = 0.0
        else:
            factor = 1.0 if v is not None else max(0.0, (w - 1) / w) if w > 0 else 0.0
            w = min(w, 4.0)
            w = w * factor if v is not None or not ignore_na else w
        if v is not None:
            m, w = v if m is None else (w * m + v) / (w + 1), w + 1
        want.append(m)
    got = out(S.ewma(frame(spark, x), "x", "y", com=4.0, adjust="linear", ignore_na=ignore_na))
    assert all(a is None and b is None or abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_means_together_equal_means_alone(spark):
    rng = np.random.default_rng(2)
    rows = [("a", t, None if t % 5 == 2 else float(rng.random()), None if t % 7 == 3 else float(rng.random())) for t in range(120)]
    df = spark.createDataFrame(rows, "k string, t int, x double, z double")
    both = S.ewma_together(df, {"mx": "x", "mz": "z"}, alpha=0.2)
    alone = S.ewma(S.ewma(df, "x", "mx", alpha=0.2), "z", "mz", alpha=0.2)
    for c in ("mx", "mz"):
        assert np.allclose(np.array(out(both, c), float), np.array(out(alone, c), float), equal_nan=True)
    assert ts.Ewm(S, alpha=0.2).mean(df, "x", "y").columns[-1] == "y"


def test_fold_ends_keys_apart(spark):
    df = frame(spark, [1, 2, 3, 4]).unionByName(frame(spark, [9, 1, 1], "b"))
    step = lambda s, row: ((row[0], row[0] >= 3), s)
    got = fd.fold(df, ["k"], ["t"], ["x"], step, lambda: None, "y double, over boolean", done="over").collect()
    assert sorted((r.k, r.y) for r in got) == [("a", 1), ("a", 2), ("a", 3), ("b", 9)]
    short = fd.fold(df, ["k"], ["t"], ["x"], step, lambda: None, "y double, over boolean", stop=1, skip_first=True).collect()
    assert sorted((r.k, r.y) for r in short) == [("a", 2), ("b", 1)]


def test_fold_holds_no_key_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("t"), F.lit(1.0).alias("x"))
        step = lambda s, row: ((s + row[0],), s + row[0])
        assert out(fd.fold(df, ["k"], ["t"], ["x"], step, lambda: 0.0, "y double")) == [float(n + 1) for n in range(1000)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dual_numbers_differentiate():
    def f(p, x):
        return ((p[0] * x).tanh() + (p[1] / (x + 2)).exp() - (p[2] + 3).log()) ** 2 + abs(p[0] - 1) * 2

    at, x, h = [0.3, -0.2, 0.8], 1.7, 1e-6
    value, _, slope = fd.value_and_gradient(f, at, x)
    plain = lambda p: (math.tanh(p[0] * x) + math.exp(p[1] / (x + 2)) - math.log(p[2] + 3)) ** 2 + abs(p[0] - 1) * 2
    assert abs(value - plain(at)) < 1e-12
    for k in range(3):
        up, down = list(at), list(at)
        up[k] += h
        down[k] -= h
        assert abs(slope[k] - (plain(up) - plain(down)) / (2 * h)) < 1e-6


@pytest.mark.parametrize("optimiser", [fd.sgd(0.05), fd.adagrad(0.3), fd.rmsprop(0.02), fd.adam(0.05)])
def test_func_optimiser_learns(optimiser):
    rng = np.random.default_rng(1)
    rows = [(float(a), 0.8 * float(a) - 0.3) for a in rng.random(600)]
    loss = lambda p, a, b: (p[0] * a + p[1] - b) ** 2
    got = run(fd.func_optimiser(loss, [0.0, 0.0], optimiser), rows)
    assert np.mean([g[0] for g in got[-50:]]) < 0.05 * np.mean([g[0] for g in got[:5]]) + 1e-4


def test_frozen_and_injected_parameters():
    rows = [(1.0, 2.0), (2.0, float("nan")), (3.0, 4.0)]
    loss = lambda p, a, b: (p[0] * a + p[1] - b) ** 2
    got = run(fd.func_optimiser(loss, [0.5, 0.25], fd.sgd(0.01), trainable=lambda k: k == 1), rows)
    assert all(g[1] == 0.5 for g in got) and got[0][2] != 0.25 and got[1][2] == got[0][2]  # a gradient that isn't finite changes nothing
    assert fd.with_params(lambda p, a: p[0] * a + p[1], [2.0, 1.0])(3.0) == 7.0
    assert [g[3] for g in run(fd.online_regression(1, fd.sgd(0.1), frozen=(1,)), [(1.0, 2.0)] * 3)] == [0.0] * 3
    ridged = run(fd.online_regression(1, fd.sgd(0.1), ridge=1.0), [(1.0, 2.0)] * 200)
    assert abs(ridged[-1][2]) < 0.9  # without it the two weights add up to 2


def test_callbacks_and_nested_folds():
    seen = []
    machine = fd.feedback(lambda o: o + 1, lambda a, raw: (a * (raw + a), raw + a), callbacks=[lambda r, o, a: seen.append(a), lambda r, o, a: a * 2])
    got = run(machine, [(float(k),) for k in range(4)])
    assert [g[0] for g in got[1:]] == [2, 15, 54][:3] and [g[3] for g in got] == [2 * a for a in seen]
    inner = fd.nested(fd.ewma_step(alpha=0.5), fd.ewma_start())
    ((ys,), _) = inner(None, ([1.0, None, 3.0],))
    assert ys[0] == 1.0 and ys[1] == 1.0 and len(ys) == 3
    piped = fd.piped(fd.arma([], [1.0]), fd.arma([0.5], []))
    assert [y for (y,) in run(piped, [(1.0,), (0.0,), (0.0,)])] == [1.0, 1.5, 0.75]


def test_arrays_and_trees(spark):
    a, b = F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (4.0, 5.0, 6.0)))
    row = spark.range(1).select(
        scalar.dot(a, b).alias("dot"), scalar.outer(a, b).alias("outer"), scalar.roll(a, 1).alias("r"), scalar.roll(a, -1).alias("l"), scalar.roll(F.array().cast("array<double>"), 2).alias("e"),
        scalar.matvec(F.array(a, b), a).alias("mv"), scalar.access(a, F.lit(-1)).alias("none"), scalar.access(a, F.lit(2)).alias("third"),
    ).first()
    assert (row.dot, row.outer[1], row.r, row.l, row.e, row.mv, row.none, row.third) == (32, [8, 10, 12], [3, 1, 2], [2, 3, 1], [], [14, 32], None, 3)
    tree = {"a": [1, (2, 3)], "b": 4}
    assert scalar.tree_map(lambda x, y: x + y, tree, tree) == {"a": [2, (4, 6)], "b": 8} and scalar.tree_leaves(tree) == [1, 2, 3, 4]


def test_codes_come_back(spark):
    times = [datetime.datetime(2024, 1, 2, 3, 4, 5, 678901), datetime.datetime(1969, 12, 31, 23, 59, 59), None]
    df = spark.createDataFrame([(n, t, v) for n, (t, v) in enumerate(zip(times, [2**63 - 1, 2**34, 10]))], "n int, t timestamp_ntz, v long")
    back = df.select("t", scalar.decode_timestamp(*scalar.encode_timestamp(F.col("t"))).alias("u"), "v", scalar.decode_int64(*scalar.encode_int64(F.col("v"))).alias("w")).collect()
    assert all(r.t == r.u and r.v == r.w for r in back)
    labels = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "s string")
    codes = scalar.label_codes(labels, "s", "code")
    assert {r.s: r.code for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    again = scalar.label_decode(scalar.label_encode(labels, "s", "code").drop("s"), codes, "code", "s")
    assert sorted(str(r.s) for r in again.collect()) == ["None", "a", "a", "b", "c"]


def test_sources(spark):
    assert tables.grid(spark, 3, 4, 5).count() == 60
    daily, hourly = tables.two_time_scales(spark, 2, 6, n_lat=2, n_lon=2)
    assert (daily.count(), hourly.count(), daily.columns[0], hourly.columns[-1]) == (8, 24, "day", "ground")
    assert tables.times_grid(spark, 2, 2, 3).where("time <> data").count() == 0
    got = tables.from_records(spark, ({"obs": float(k)} for k in range(25)), "obs double", batch=10)
    assert [r._step for r in got.orderBy("_step").collect()] == list(range(25)) and tables.from_records(spark, [], "obs double").count() == 0
    one = spark.createDataFrame([(3,)], "m int")
    assert tables.with_scalar(spark.range(2), one, "m").where("m = 3").count() == 2
    assert tables.with_scalar(spark.range(2), one.where("false"), "m").where("m is null").count() == 2
    with pytest.raises(ValueError):
        tables.with_scalar(spark.range(2), one.unionByName(one), "m")


def test_timelines(spark):
    a, b = frame(spark, [1, 2]), frame(spark, [3])
    assert sy.local_stream({"a": a}) == "a" and sy.local_stream({"a": a, "b": b}, "b") == "b"
    assert sy.synchronise_streams({"a": a}).count() == 2
    for streams, local in (({"a": a, "b": b}, None), ({"a": a}, "z")):
        with pytest.raises(ValueError):
            sy.local_stream(streams, local)
    with pytest.raises(ValueError):
        sy.synchronise_streams({"a": a, "b": b}, local="a")


def test_memories(spark):
    used = mem.hierarchical_memory()
    assert (used["recent"], used["medium"], used["long"], used["total"]) == (800, 12, 8044, 8856) and abs(used["compression_ratio"] - 10.03) < 0.01
    df = frame(spark, range(1, 13))

    @mem.compressed_memory(4, "downsample")
    def newest(d, series, x):
        return d.withColumn("y", F.element_at("memory", -1))

    assert out(newest(df, S, "x"))[-1] == 12
    with pytest.raises(ValueError):
        mem.compressed_memory(4, "guess")(lambda d, s, x: d)(df, S, "x")
    level = mem.with_hierarchical_memory(medium=5, long=10)(lambda d, series, x: d)(df, S, "x")
    assert out(level, "long_median") == [1, *[0] * 9, 6, 0] and np.allclose(out(level, "medium_ewma")[:6], [1, 1, 1, 1, 1, (0.9 * 1 + 6) / 1.9])
    assert sorted(out(mem.recent(df, S, 3), "x")) == [10, 11, 12]


def test_stream_to_files(spark, tmp_path):
    spark.range(20).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("t"), F.lit(1.0).alias("x")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t int, x double").parquet(str(tmp_path / "in"))
    folded = keyed.fold_stream(stream, "k", ["t"], ["x"], lambda s, row: ((s + row[0],), s + row[0]), lambda: 0.0, "y double")
    assert sorted(r.y for r in keyed.drain(folded, f"file://{tmp_path}/out").collect()) == [float(n) for n in range(1, 21)]


def test_inspection(spark):
    from chronofold.plans import inspect

    df = frame(spark, [5, 50, 500])
    seen, metrics = inspect.watched(df, "w1", most=F.max("x"))
    assert seen.count() == 3 and metrics.get == {"rows": 3, "most": 500.0}
    got = inspect.flagged(df, large=F.col("x") > 40, huge=F.col("x") > 400).orderBy("t").collect()
    assert [r.events for r in got] == [["large"], ["large", "huge"]]
    profile = inspect.profiled(df.groupBy("k").count())
    assert profile.rows == 1 and profile.seconds > 0 and any("Exchange" in o for o in profile.bottlenecks())
    assert inspect.trend([1, 2, 3, 4])["growing"] and not inspect.trend([5, 5, 5])["growing"] and inspect.trend([2, 4])["slope"] == 2


def test_timestamps_come_back_to_the_microsecond(spark):
    times = [datetime.datetime(2024, 1, 1, 0, 0, 11, 172425) + datetime.timedelta(microseconds=k * 7_654_321) for k in range(500)] + [datetime.datetime(1969, 12, 31, 23, 59, 59, 999_999)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    back = df.select("t", scalar.decode_timestamp(*scalar.encode_timestamp(F.col("t"))).alias("u")).collect()
    assert [r.u for r in back] == [r.t for r in back]
    ns = spark.createDataFrame([(1,), (1999,), (-1,)], "n long").select(F.unix_micros(scalar.decode_timestamp(*scalar.encode_int64(F.col("n"))).cast("timestamp")).alias("m"))
    assert [r.m for r in ns.collect()] == [0, 1, -1]


def test_folds_after_a_join_on_the_key_keep_keys_whole(spark):
    rows = spark.range(0, 4_000, numPartitions=8).select((F.col("id") % 5).alias("k"), "id", F.lit(1.0).alias("x"))
    few = spark.range(0, 5, numPartitions=3).groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("one")).withColumnRenamed("id", "k")
    # a sorted join is planned, and turned to a broadcast when the sizes are known; so few rows would go to one task
    how = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {c: spark.conf.get(c, None) for c in how}
    for c, to in how.items():
        spark.conf.set(c, to)
    try:
        counted = fd.fold(rows.join(few, "k", "left"), ["k"], ["id"], ["x", "one"], lambda n, row: ((n + 1.0,), n + 1.0), lambda: 0.0, "n double")
        assert all(r.n == r.id // 5 + 1 for r in counted.collect())
    finally:
        for c, to in was.items():
            spark.conf.unset(c) if to is None else spark.conf.set(c, to)
