"""Connected components of an edge table, without collecting edges or labels.

Every partition first contracts its own edges, some at a time, to forests of stars
(union-find), then large-star and small-star rounds run as joins and pre-aggregated
groupings until the edge table stands still. Edges point from the larger vertex to the
smaller. A vertex of many edges meets only the one row of its own smallest neighbour, in
joins whose hot keys Spark can split, and not at all once it is the centre of a star.
Each round's edges are written to the shared folder. Rows with a null end are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_sort, cut, released

#: Edges that a task contracts together; its memory is bounded by them.
TOGETHER = 200_000


def _contract(batches):
    """Stars (vertex, smallest id of its tree) over runs of a partition's edges."""
    edges, held = [], 0
    for batch in batches:
        edges.append(batch)
        held += batch.num_rows
        if held >= TOGETHER:
            yield from _forest(edges)
            edges, held = [], 0
    yield from _forest(edges)


def _forest(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a is None or b is None:
                continue
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    leaves = [x for x in parent if find(x) != x]
    for start in range(0, len(leaves), 50_000):
        some = leaves[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["a", "b"])


def _stars(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(released(_contract), "a long, b long")


def _least(edges: DataFrame) -> DataFrame:
    """(k, m, n): each vertex that has smaller neighbours, the least of them, their number."""
    found = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    # a key that isn't the grouping's own: the join then has an exchange of its own on either side and can split hot keys
    return found.select(F.col("a").bitwiseXOR(F.lit(0)).alias("k"), "m", "n")


def _round(edges: DataFrame) -> DataFrame:
    """edges: distinct (a, b) with a > b."""
    up = _least(edges).select("k", "m")
    large = edges.join(by_sort(up), F.col("b") == F.col("k"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
    least = _least(large)
    several = least.where("n > 1").select("k", "m")
    others = large.join(by_sort(several), F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every vertex that has a link; component is the smallest id reachable.

    Vertices without a link are not listed (their component is themselves). An empty
    edge table gives an empty result.
    """
    now = cut(_stars(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        after = cut(_round(now), "edges")
        new = _mark(after)
        now, was, mark = after, mark, new
        if new == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
