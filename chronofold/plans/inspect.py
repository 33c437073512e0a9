"""Looking at what runs: observed metrics, run profiles, and growth of a series of samples."""

from __future__ import annotations

import re
import time
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """One run: seconds, rows, and how often each physical operator stands in the plan."""

    seconds: float
    rows: int
    operators: Counter = field(default_factory=Counter)

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0

    def bottlenecks(self) -> list[str]:
        """Operators that move or sort rows, or leave the JVM, the most frequent first."""
        return [name for name, _ in self.operators.most_common() if re.search("Exchange|Sort|Python|Pandas|Arrow|NestedLoop|Cartesian", name)]


def watched(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that are taken while it runs, and where they can be read afterwards; the rows are counted in any case."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]), seen


def flagged(df: DataFrame, **predicates: Column) -> DataFrame:
    """The rows for which a predicate holds, with the names of those that do in ``events``."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))
    return df.withColumn("events", names).where(F.size("events") > 0)


def operators(df: DataFrame) -> Counter:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"^[\s:|+*()\d-]*([A-Z]\w+)", plan, re.M))


def profiled(df: DataFrame) -> Profile:
    """Run ``df`` to the end without keeping its rows."""
    seen, metrics = watched(df, "profile")
    start = time.perf_counter()
    seen.write.format("noop").mode("overwrite").save()
    return Profile(time.perf_counter() - start, metrics.get["rows"], operators(df))


def trend(samples: list[float]) -> dict[str, Any]:
    """Least-squares slope per sample, its share of the mean, and whether the samples keep growing."""
    n = len(samples)
    if n < 2:
        return {"slope": 0.0, "relative": 0.0, "growing": False}
    mean_t, mean = (n - 1) / 2, sum(samples) / n
    slope = sum((t - mean_t) * (v - mean) for t, v in enumerate(samples)) / sum((t - mean_t) ** 2 for t in range(n))
    relative = slope / mean if mean else 0.0
    return {"slope": slope, "relative": relative, "growing": relative > 0.01}
