"""Stream synchronisation: strict backward as-of joins of secondary streams to a local one.

A local row sees the last secondary row strictly before its time (or before the start of
its period). The join is a union of the streams and one null-skipping window: one exchange,
no join. Without keys that window would run in one task, so the union is first dealt by
ranges of time: every period's last secondary row is carried to the periods after it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Secondary:
    """A secondary stream: its rows (``time``, ``order`` break ties), the columns it gives, and how it is seen."""

    name: str
    df: DataFrame
    columns: tuple[str, ...]
    time: str = "ts"
    order: tuple[str, ...] = ()
    freq: str | None = None  # see only what came before the start of the local row's period
    ffill: bool = True  # else a value shows only on the local row on which it arrives
    buffer: int = 0  # show the last n rows as an array, left-padded
    key: tuple[str, ...] = field(default=())


def cut_time(time: Column, freq: str | None) -> Column:
    return time if freq is None else F.date_trunc({"d": "day", "h": "hour"}.get(freq, freq), time).cast("timestamp_ntz")


def _payload(sec: Secondary) -> DataFrame:
    order = Window.partitionBy(*sec.key, F.lit(0)).orderBy(sec.time, *sec.order) if not sec.key else Window.partitionBy(*sec.key).orderBy(sec.time, *sec.order)
    row = F.struct(*[F.col(c) for c in sec.columns])
    rows = sec.df
    if sec.buffer:
        got = F.collect_list(row).over(order.rowsBetween(-(sec.buffer - 1), 0))
        blank = F.struct(*[F.lit(None).cast(sec.df.schema[c].dataType).alias(c) for c in sec.columns])
        row = F.concat(F.array_repeat(blank, F.lit(sec.buffer) - F.size(got)), got)
    nth = F.struct(F.col(sec.time), *[F.col(c) for c in sec.order])
    return rows.select(*sec.key, F.col(sec.time).alias("_cut"), nth.alias("_nth"), row.alias("_row"))


def synchronise(local: DataFrame, secondaries: list[Secondary], time: str = "ts", order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """``local`` with one column per secondary: a struct of its columns, or an array of them if buffered.

    A secondary row at exactly the local time is not yet seen. Streams with key columns
    are synchronised within equal keys.
    """
    out = local
    for sec in secondaries:
        out = _one(out, sec, time, order)
    return out


def local_stream(streams: dict[str, DataFrame], local: str | None = None) -> str:
    """The stream whose rows set the time: the one that is named, or the only one."""
    if local is not None:
        if local not in streams:
            raise ValueError(f"no stream {local!r}")
        return local
    if len(streams) != 1:
        raise ValueError("several timelines: name the local one")
    return next(iter(streams))


def synchronise_streams(streams: dict[str, DataFrame], secondaries: dict[str, Secondary] | None = None, local: str | None = None, **how) -> DataFrame:
    """The local stream with the others as ``secondaries`` describes them; a single stream is given as it is."""
    name = local_stream(streams, local)
    others = [s for s in streams if s != name]
    if missing := [s for s in others if s not in (secondaries or {})]:
        raise ValueError(f"nothing says how to see {missing}")
    return synchronise(streams[name], [secondaries[s] for s in others], **how) if others else streams[name]


def _one(local: DataFrame, sec: Secondary, time: str, order: tuple[str, ...]) -> DataFrame:
    right = _payload(sec)
    seen = F.struct("_nth", "_row")
    both = local.withColumn("_cut", cut_time(F.col(time), sec.freq)).withColumn("_side", F.lit(0)).withColumn("_got", F.lit(None).cast(right.select(seen.alias("s")).schema["s"].dataType))
    other = right.select(*sec.key, "_cut", F.lit(1).alias("_side"), seen.alias("_got"))
    union = both.unionByName(other, allowMissingColumns=True)
    if sec.key:
        w = Window.partitionBy(*sec.key).orderBy("_cut", "_side", F.col("_got._nth").asc_nulls_first(), *order)
        found = union.withColumn("_at", F.last("_got", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        rows = found.where("_side = 0")
    else:
        # deal by day: within a day the window, before it the last row of any earlier day
        day = F.date_trunc("day", F.col("_cut"))
        dealt = union.withColumn("_day", day)
        w = Window.partitionBy("_day").orderBy("_cut", "_side", F.col("_got._nth").asc_nulls_first(), *order)
        inside = dealt.withColumn("_at", F.last("_got", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        lasts = dealt.groupBy("_day").agg(F.max(F.when(F.col("_side") == 1, F.struct("_cut", "_got._nth", "_got._row"))).alias("_last"))
        # one row per day
        carry = lasts.withColumn("_one", F.lit(0)).withColumn("_before", F.last("_last", ignorenulls=True).over(Window.partitionBy("_one").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)))
        carried = carry.select(F.col("_day").alias("_cday"), F.struct(F.col("_before._nth").alias("_nth"), F.col("_before._row").alias("_row")).alias("_carried"), F.col("_before").isNotNull().alias("_has"))
        rows = inside.where("_side = 0").join(carried, F.col("_day").eqNullSafe(F.col("_cday")), "left").drop("_cday")
        rows = rows.withColumn("_at", F.coalesce("_at", F.when(F.col("_has"), F.col("_carried")))).drop("_carried", "_has")
    shown = F.col("_at._row")
    if not sec.ffill:
        parts = (*sec.key,) if sec.key else ("_day",)
        before = F.lag("_at").over(Window.partitionBy(*parts).orderBy("_cut", *order))
        first = F.row_number().over(Window.partitionBy(*parts).orderBy("_cut", *order)) == 1
        if sec.key:
            arrived = ~F.col("_at._nth").eqNullSafe(before["_nth"])
        else:
            # the first local row of a day looks at the last one of the days before
            ends = rows.groupBy("_day").agg(F.max(F.struct("_cut", *order, F.col("_at._nth").alias("_nth"))).alias("_end")).withColumn("_one", F.lit(0))
            ends = ends.select(F.col("_day").alias("_d"), F.lag("_end").over(Window.partitionBy("_one").orderBy("_day")).getField("_nth").alias("_prior"))
            rows = rows.join(ends, F.col("_day") == F.col("_d"), "left").drop("_d")
            arrived = ~F.col("_at._nth").eqNullSafe(F.when(first, F.col("_prior")).otherwise(before["_nth"]))
        shown = F.when(arrived, shown)
    return rows.withColumn(sec.name, shown).select(*local.columns, sec.name)
