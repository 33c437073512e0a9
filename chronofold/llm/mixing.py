"""Mixing sources to target weights by a Pfair schedule, in DataFrame functions alone.

A source's documents, in order, form blocks. Weights are whole numbers a; a round has
sum(a) slots, in which the i-th of a source's m blocks is released at floor((i-1) M / m)
and due at ceil(i M / m), M being the slots of the round. In every slot the released block
with the earliest deadline goes (ties: by source). Such a schedule always exists, and at
no time is a source a whole block away from its share. At the end of a round every source
has exactly its share, so rounds are scheduled one by one, and rounds with the same blocks
alike: only where a source ends does a round differ, so with k sources there are at most
2 k + 1 different rounds. From then on the others share in proportion to their weights.
No document is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, unused

BLOCK = 32
PERIOD = 256
POWER = 0.7


def _print_of(df: DataFrame, column: str) -> list[Column]:
    """What a column adds to its row's fingerprint; maps, which have no order, by their sorted JSON entries."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType.simpleString()
    if kind.startswith("map<"):
        c = F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(F.struct(e.alias("e")))))
    elif "map<" in kind or "variant" in kind:
        c = F.to_json(F.struct(c.alias("e")))
    return [c, F.col(f"`{column}`").isNull()]


def numbered(df: DataFrame, key: str, order: list[Column], name: str = "numbered") -> DataFrame:
    """``df`` with _index, the row's place (from 0) within its key, without bringing a key to one task.

    Rows are dealt by ranges of (key, order) and written; a row's place is its place in
    its partition plus the rows of its key in the partitions before, one sum per partition
    and key.
    """
    dealt = df.repartitionByRange(parts(df), F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    marked = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    marked = marked.withColumn("_part", F.shiftright("_at", 33))
    heads = marked.groupBy("_part", key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select("_part", key, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return marked.join(offsets, ["_part", key]).withColumn("_index", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def power_weights(sizes: DataFrame, period: int = PERIOD, power: float = POWER) -> DataFrame:
    """(_source, weight): whole weights in proportion to size ** power.

    They add up to about ``period``, or to as much more as it takes for the smallest share
    to be one slot of the round.
    """
    raised = F.pow("_blocks", F.lit(power))
    got = sizes.agg(F.sum(raised).alias("total"), F.min(raised).alias("least")).first()
    if not got["total"]:
        return sizes.select("_source", F.lit(1).cast("long").alias("weight"))
    slots = max(float(period), got["total"] / got["least"])
    return sizes.select("_source", F.greatest(F.lit(1), F.round(raised * F.lit(slots / got["total"]))).cast("long").alias("weight"))


def _asked(weights: DataFrame, named: Column) -> DataFrame:
    """(_source, weight) from the caller's table; weights that are no whole numbers of at least one are an error."""
    asked = weights.select(named.alias("_source"), F.col("weight").cast("double").alias("weight")).where("weight is not null")
    odd = asked.where("weight < 1 or weight <> floor(weight)").limit(1).collect()
    if odd:
        raise ValueError(f"weights are whole numbers of at least 1, such as 7 and 3 for 0.7 and 0.3; got {odd[0]['weight']}")
    return asked.groupBy("_source").agg(F.max("weight").cast("long").alias("weight"))


def _earliest(rates: str, slots: str) -> Column:
    """Array of the source numbers that the round's slots go to; rates: array<struct<m, ...>> by source."""
    source = F.col(rates)
    m = F.transform(source, lambda x: x["m"])
    total = F.col(slots)

    def step(state: Column, t: Column) -> Column:
        due = F.transform(
            state["next"],
            lambda i, j: F.when(
                (i <= F.get(m, j)) & (F.floor((i - 1) * total / F.get(m, j)) <= t),
                F.struct(F.ceil(i * total / F.get(m, j)).alias("due"), j.alias("j")),
            ),
        )
        chosen = F.array_min(due)["j"]
        return F.struct(
            F.transform(state["next"], lambda i, j: F.when(j == chosen, i + 1).otherwise(i)).alias("next"),
            F.concat(state["out"], F.array(chosen)).alias("out"),
        )

    start = F.struct(F.transform(source, lambda x: F.lit(1).cast("long")).alias("next"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), start, step, lambda state: state["out"])


def schedule(sizes: DataFrame, weights: DataFrame) -> DataFrame:
    """(_source, _block, slot): every block's slot.

    sizes: (_source, _blocks); weights: (_source, weight). A source without a weight, or
    with one below 1, counts as weight 1.
    """
    # a few rows, one per source: cut so that it isn't recomputed by each use
    plan = cut(sizes.join(weights, "_source", "left").select("_source", "_blocks", F.greatest(F.coalesce(F.col("weight").cast("long"), F.lit(1)), F.lit(1)).alias("a")).where("_blocks > 0"), "sources")
    whole = F.floor(F.col("_blocks") / F.col("a")).cast("long")
    rest = F.col("_blocks") % F.col("a") > 0
    starts = plan.select(F.explode(F.when(rest, F.array(F.lit(0), whole, whole + 1)).otherwise(F.array(F.lit(0).cast("long"), whole))).alias("start")).distinct()
    by_start = Window.partitionBy("_all").orderBy("start")
    segments = cut(starts.withColumn("_all", F.lit(0)).select("start", F.lead("start").over(by_start).alias("stop"), (F.row_number().over(by_start) - 1).alias("seg")).where("stop is not null"), "segments")
    # a source's rounds end before ``stop`` of its last segment: it meets each of its segments once, by number
    first_out = plan.withColumn("start", F.when(rest, whole + 1).otherwise(whole))
    last = first_out.join(segments.select(F.col("stop").alias("start"), "seg"), "start").select("_source", "_blocks", "a", F.explode(F.sequence(F.lit(0), F.col("seg"))).alias("seg"))
    taking = last.join(segments, "seg").select("seg", "start", "stop", "_source", F.least("a", F.col("_blocks") - F.col("a") * F.col("start")).alias("m"), "a").where("m > 0")
    rounds = taking.groupBy("seg", "start", "stop").agg(F.sort_array(F.collect_list(F.struct("_source", "m", "a"))).alias("rates"), F.sum("m").alias("slots"))
    solved = rounds.withColumn("out", _earliest("rates", "slots"))
    before = Window.partitionBy("_all").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    based = cut(solved.withColumn("_all", F.lit(0)).withColumn("base", F.coalesce(F.sum(F.col("slots") * (F.col("stop") - F.col("start"))).over(before), F.lit(0))).drop("_all"), "rounds")
    slots = based.select("seg", "rates", F.posexplode("out").alias("at", "j")).withColumn("r", F.get("rates", F.col("j")))
    nth = F.row_number().over(Window.partitionBy("seg", "j").orderBy("at"))
    pattern = slots.select("seg", F.col("r._source").alias("_source"), F.col("r.a").alias("a"), "at", (nth - 1).alias("i"))
    runs = based.select("seg", "start", "slots", "base", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("round"))
    return runs.join(pattern, "seg").select("_source", (F.col("round") * F.col("a") + F.col("i")).alias("_block"), (F.col("base") + (F.col("round") - F.col("start")) * F.col("slots") + F.col("at")).alias("slot"), F.col("a").alias("weight"))


def mix(df: DataFrame, weights: DataFrame | None = None, source_col: str = "source", order_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``df`` with block, slot, weight and position added.

    position grows with the slot and, inside a block, with the order column; sorting by it
    gives the mixed corpus. weights: (source_col, weight), whole numbers of at least 1; by
    default in proportion to size ** 0.7. A null source is a source of its own; rows that
    tie in the order (repeated rows, null ids first) follow the order of all their columns;
    columns with the added names are replaced; an empty table gives an empty result.
    """
    added = ("block", "slot", "weight", "position")
    plain = df.drop(*added)
    (place,) = unused(plain, "_place")
    placed = _placed(plain, weights, place, source_col, order_col, block)
    return placed.select(*plain.columns, *[F.col(f"{place}.{c}") for c in added])


def _placed(plain: DataFrame, weights: DataFrame | None, place: str, source_col: str = "source", order_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``plain`` with the struct ``place``."""
    named = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    every = [c for name in plain.columns for c in _print_of(plain, name)]
    one, two = unused(plain, "_h1", "_h2")
    print_ = [F.xxhash64(F.lit(seed), *every) for seed in (1, 2)]
    # only the order's columns and the row's fingerprint are sorted and written, not the row
    thin = plain.select(named.alias("_source"), F.col(order_col).alias("_order"), print_[0].alias("_h1"), print_[1].alias("_h2"))
    rows = numbered(thin, "_source", [F.col("_order").asc_nulls_first(), F.col("_h1"), F.col("_h2")])
    rows = rows.withColumn("_block", F.floor(F.col("_index") / block).cast("long"))
    sizes = cut(rows.groupBy("_source").agg((F.max("_block") + 1).alias("_blocks")), "sizes")
    asked = power_weights(sizes) if weights is None else _asked(weights, named)
    spot = F.struct((F.col("slot") * block + F.col("_index") % block).alias("position"), F.col("_block").alias("block"), "slot", "weight")
    placed = rows.join(schedule(sizes, asked), ["_source", "_block"]).select(F.col("_h1").alias(one), F.col("_h2").alias(two), spot.alias(place))
    # rows that are alike in all columns are one row here, and it takes each of their places
    once = plain.withColumns({one: print_[0], two: print_[1]}).dropDuplicates([one, two])
    return placed.join(once, [one, two]).select(*plain.columns, place)


def mixed_documents(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows and columns of ``df``, dealt by ranges of their position and sorted by it."""
    (place,) = unused(df, "_place")
    placed = _placed(df, weights, place)
    return placed.repartitionByRange(parts(df), f"{place}.position").sortWithinPartitions(f"{place}.position").drop(place)
