"""Event-driven and reset-driven computation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import Series

Module = Callable[[DataFrame, Series], DataFrame]


def update_on_event(df: DataFrame, series: Series, event: Column, module: Module, out: str, initial=None) -> DataFrame:
    """The module advances on event rows only; other rows repeat its last output (``initial`` before the first).

    The module runs in windows that the events have to themselves (an extra key splits
    event rows from the rest), so no rows are joined back.
    """
    marked = df.withColumn("_on", F.coalesce(event, F.lit(False)))
    ran = module(marked, Series((*series.key, "_on"), series.order))
    # an event whose output is missing must still replace the one before
    nth = F.last(F.when(F.col("_on"), F.struct(F.col(out).alias("y"))), ignorenulls=True).over(series.so_far())
    shown = F.when(nth.isNull(), F.lit(initial).cast("double")).otherwise(nth["y"])
    return ran.withColumn(out, shown).drop("_on")


def cache_on_event(df: DataFrame, series: Series, event: Column, y: Column, out: str, initial=None) -> DataFrame:
    """The output is refreshed on event rows only, while the computation behind ``y`` sees every row."""
    held = F.last(F.when(event, F.struct(y.alias("y"))), ignorenulls=True).over(series.so_far())
    return df.withColumn(out, F.when(held.isNull(), F.lit(initial).cast("double")).otherwise(held["y"]))


def scan_with_reset(df: DataFrame, series: Series, reset: Column, module: Module, preserve_state: bool = True) -> DataFrame:
    """The module starts anew after each row on which ``reset`` holds; without ``preserve_state`` there is nothing to reset."""
    if not preserve_state:
        return module(df, series)
    w = series.window()
    marked = df.withColumn("_r", F.coalesce(reset, F.lit(False)).cast("int"))
    segments = marked.withColumn("_seg", F.coalesce(F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return module(segments, Series((*series.key, "_seg"), series.order)).drop("_r", "_seg")


def conditional(cond: Column, y: Column, otherwise: Column) -> Column:
    """y where the condition holds, the input as it is elsewhere."""
    return F.when(cond, y).otherwise(otherwise)


def compose(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps fed forward; each sees the columns of the ones before."""
    for step in steps:
        df = step(df)
    return df


Pattern = Callable[[dict[str, Column]], "dict[str, Column] | Column"]


def composed(patterns: dict[str, Pattern], inputs: dict[str, Column], strategy: str = "pipeline") -> dict[str, dict[str, Column] | Column]:
    """Each pattern's output columns, by name.

    A pattern maps named columns to named columns (or to one column). "pipeline": its
    output joins what the next pattern sees, or replaces it where it is one column.
    "parallel": all see the inputs. "hierarchical": all see the inputs until a pattern
    gives an output named influence, which from then on stands in their place.
    """
    if strategy not in ("pipeline", "parallel", "hierarchical"):
        raise ValueError(f"unknown composition {strategy!r}")
    seen, out = dict(inputs), {}
    for name, pattern in patterns.items():
        got = out[name] = pattern(seen)
        if strategy == "pipeline":
            seen = {**seen, **got} if isinstance(got, dict) else {"x": got}
        elif strategy == "hierarchical" and isinstance(got, dict) and "influence" in got:
            seen = {"x": got["influence"]}
    return out


def levels_of(names: list[str], needs: dict[str, list[str]]) -> dict[str, int]:
    """How deep each state's dependencies go; a dependency that leads back to itself counts as none."""

    def depth(name: str, path: frozenset) -> int:
        below = [depth(n, path | {name}) for n in needs.get(name, ()) if n not in path | {name}]
        return 1 + max(below) if below else int(bool(needs.get(name)))

    return {n: depth(n, frozenset()) for n in names}


def execution_order(names: list[str], needs: dict[str, list[str]]) -> list[str]:
    """Names with each behind what it needs; of a circle the first named goes first."""
    left, order = list(names), []
    while left:
        ready = [n for n in left if not any(d in left for d in needs.get(n, ()))] or left[:1]
        order += ready
        left = [n for n in left if n not in ready]
    return order


def hierarchical_machine(states: dict[str, Pattern], inputs: dict[str, Column], needs: dict[str, list[str]] | None = None, strategy: str = "hierarchical", weight: float = 0.1) -> dict[str, dict[str, Column]]:
    """Every state's output columns, run in the order of their dependencies.

    With the "hierarchical" strategy a state's values are drawn, level by level, towards
    the equally named values of every state on a level above it (``blend``). A state that
    raises gives the columns error and status instead, and takes part in no blending.
    """
    needs, found = needs or {}, {}
    for name in execution_order(list(states), needs):
        try:
            found[name] = dict(states[name](inputs))
        except Exception as e:  # noqa: BLE001  a failed state is an output, not the end of the machine
            found[name] = {"error": F.lit(str(e)), "status": F.lit("failed")}
    if strategy != "hierarchical":
        return found
    level, done = levels_of(list(states), needs), {}
    for name in sorted(found, key=lambda n: level[n]):
        own = found[name]
        for above in [n for n in done if level[n] < level[name] and "error" not in found[n]]:
            own = {k: blend(v, done[above][k], weight) if k in done[above] and "error" not in own else v for k, v in own.items()}
        done[name] = own
    return done


def history(series: Series, x: Column, n: int) -> Column:
    """The n values before the row, oldest first, as they come (fewer at the start)."""
    return F.collect_list(x).over(series.window().rowsBetween(-n, -1))


def relevant_states(past: Column, k: int) -> tuple[Column, Column]:
    """(the k oldest of the kept states, their equal weights)"""
    return F.slice(past, 1, k), F.transform(F.slice(past, 1, k), lambda v: F.lit(1.0) / F.size(past))


def attended(x: Column, past: Column, weight: float = 0.1) -> Column:
    """x plus a share of its attention over the past: past values weighted by the softmax of their products with x."""
    top = F.array_max(F.transform(past, lambda v: v * x))
    powers = F.transform(past, lambda v: F.exp(v * x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, p: a + p)
    context = F.aggregate(F.zip_with(past, powers, lambda v, p: v * p), F.lit(0.0), lambda a, v: a + v) / total
    return F.when(F.size(past) > 0, x + weight * context).otherwise(x)


def blend(own: Column, higher: Column, weight: float = 0.1) -> Column:
    """A lower level's value, drawn towards the level above it."""
    return (1 - weight) * own + weight * higher


def step_interval(series: Series, k: int) -> Column:
    return series.counter() % k == 0
