"""Embedding near-duplicates by NN-descent over a threshold graph.

Equal vectors of a label are one vertex. Neighbour lists start from random-hyperplane
buckets (a few tables, key length by the label's size; hot buckets are split into bounded
cells in which all pairs still meet). Then lists are refined: a vertex is compared with its
neighbours' neighbours, until a round finds no new link. A list holds a vertex's ``K`` best;
a vertex whose K best all are links is saturated, and its list grows to twice the length
each round, up to ``WIDE`` times.

What links is kept as a forest: buckets and rounds give edges that connect what they found,
never all pairs of a dense group, and vertices that are connected already are not compared
again. A sample of vertices, enlarged until it has seen enough true links, is compared with
all others by brute force; while links are missed, tables are added and the lists refined
again, and if that doesn't reach the wanted recall every block of a label is compared with
every other. At the end the links inside each component are counted, block by block and
exactly: a block gives one number for each of its vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_number, cut, deal_into_cells, numbered_ids, parts, released, small, whole_numbers
from .components import components

THRESHOLD = 0.93
K = 8
WIDE = 8
FLOOR = 0.6  # a pair below it doesn't enter a list
LEAF = 96
TABLES = 4
RECALL = 0.99
#: Audited vertices: at first, and at most.
AUDIT, MOST_AUDITED = 256, 4096
#: True links that an audit must have seen, unless it has looked at every vertex or at MOST_AUDITED.
EVIDENCE = 100
CELL = 512


def _unit(batches):
    """(id, label, u): unit vectors as float64 bytes; null where a vector can't link."""
    for batch in small(batches, 2048):
        units = []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            u = None
            if label is not None and v and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                    x = x / top  # no overflow or underflow in the square
                    u = (x / math.sqrt(float(x @ x))).astype("<f8").tobytes()
            units.append(u)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], ["id", "label", "u"])


def _codes(first: int, tables: int):
    """Bucket codes of a row in ``tables`` tables from number ``first`` on, by the signs of random projections."""

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in small(batches, 1024):
            lengths = pc.binary_length(batch.column(2)).to_numpy()
            bits = batch.column(3).to_numpy()
            for size in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == size))
                rows = batch.take(at)
                m = np.frombuffer(b"".join(rows.column(2).to_pylist()), "<f8").reshape(len(at), -1)
                keep = (np.int64(1) << bits[at.to_numpy()].astype(np.int64)) - 1
                for t in range(first, first + tables):
                    if (t, size) not in planes:
                        planes[t, size] = np.random.default_rng([17, t, size // 8]).standard_normal((size // 8, 48))
                    code = (m @ planes[t, size] > 0) @ (np.int64(1) << np.arange(48)) & keep
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(np.full(len(at), t, np.int32)), pa.array(code, pa.int64()), pa.array(np.full(len(at), size, np.int32))], ["rep", "label", "u", "tab", "code", "size"])

    return run


PAIRS = "a long, b long, sim double, kept boolean"


def _pairs(a, b, sim, kept) -> pa.RecordBatch:
    """Pairs with the smaller vertex first; kept: an edge of a forest, not only an entry of a list."""
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(sim, pa.float64()), pa.array(kept, pa.bool_())], ["a", "b", "sim", "kept"])


def _spanning(m: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest that connects what the threshold links among the rows of m; the matrix is never whole in memory."""
    left, tails, heads = np.arange(len(m)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:256], front[256:]
            near = m[left] @ m[some].T >= threshold
            hit = near.any(axis=1)
            tails.append(left[hit])
            heads.append(some[near[hit].argmax(axis=1)])
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return (np.concatenate(tails), np.concatenate(heads)) if tails else (np.empty(0, int), np.empty(0, int))


def _cells(batches, found):
    """Rows (cell, id, u, ...) come sorted by cell: ``found`` of each cell's columns."""
    now, rows = None, []
    for batch in small(batches, 1024):
        for cell, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if cell != now:
                if len(rows) > 1:
                    yield from found(*zip(*rows))
                now, rows = cell, []
            rows.append(row)
    if len(rows) > 1:
        yield from found(*zip(*rows))


def _matrix(units) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1)


def _cell_lists(threshold: float, k: int, floor: float):
    """Each cell gives its rows' lists, and a forest of its links."""

    def found(ids, units):
        ids, m = np.array(ids, np.int64), _matrix(units)
        for lo in range(0, len(ids), 512):
            s = m[lo : lo + 512] @ m.T
            s[np.arange(len(s)), lo + np.arange(len(s))] = -2.0
            n = min(k, s.shape[1] - 1)
            best = np.argpartition(s, -n, axis=1)[:, -n:]
            i = np.repeat(np.arange(len(s)), n)
            sim = s[i, best.ravel()]
            ok = sim >= floor
            yield _pairs(ids[lo + i][ok], ids[best.ravel()][ok], sim[ok], np.zeros(int(ok.sum()), bool))
        a, b = _spanning(m, threshold)
        yield _pairs(ids[a], ids[b], np.full(len(a), threshold), np.ones(len(a), bool))

    return lambda batches: _cells(batches, found)


def _similar(floor: float, threshold: float):
    def run(batches):
        for batch in small(batches, 4096):
            if batch.num_rows:
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                ua, ub = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                sims = np.full(len(a), -2.0)
                sizes = np.array([len(x) if len(x) == len(y) else -1 for x, y in zip(ua, ub)])
                for size in np.unique(sizes[sizes > 0]).tolist():
                    at = np.flatnonzero(sizes == size)
                    sims[at] = np.einsum("ij,ij->i", _matrix([ua[k] for k in at]), _matrix([ub[k] for k in at]))
                keep = np.flatnonzero(sims >= floor)
                yield _pairs(a[keep], b[keep], sims[keep], sims[keep] >= threshold)

    return run


def _buckets(reps: DataFrame, first: int, tables: int, threshold: float, k: int, floor: float) -> DataFrame:
    sizes = reps.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    bits = F.least(F.lit(48), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(LEAF))))).cast("int").alias("bits")
    kind = reps.schema["label"].dataType.simpleString()
    coded = reps.join(sizes, "label").select("rep", "label", "u", bits).mapInArrow(released(_codes(first, tables)), f"rep long, label {kind}, u binary, tab int, code long, size int")
    cells = deal_into_cells(coded, ["tab", "label", "code", "size"], "rep", CELL)
    dealt = cells.select("cell", "rep", "u").repartition(parts(reps), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(released(_cell_lists(threshold, k, floor)), PAIRS)


def _both_ways(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("a").alias("v"), F.col("b").alias("w"), "sim").unionByName(lists.select(F.col("b").alias("v"), F.col("a").alias("w"), "sim"))


def _trimmed(lists: DataFrame, wide: int, threshold: float, k: int) -> DataFrame:
    """(v, w): each vertex's k best, or ``wide`` times as many where the k best all are links."""
    ranked = _both_ways(lists).withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "w"))).where(F.col("r") <= k * wide)
    saturated = ranked.where((F.col("r") == k) & (F.col("sim") >= threshold)).select("v", F.lit(k * wide).alias("most"))
    return ranked.join(saturated, "v", "left").where(F.col("r") <= F.coalesce("most", F.lit(k))).select("v", "w", "sim")


def _refined(reps: DataFrame, lists: DataFrame, classes: DataFrame, wide: int, threshold: float, k: int, floor: float) -> DataFrame:
    """Pairs that neighbours' neighbours add; only vertices that aren't connected yet are compared."""
    near = cut(_trimmed(lists, wide, threshold, k).select("v", "w").join(classes.withColumnsRenamed({"node": "w", "component": "of_w"}), "w", "left").select("v", "w", F.coalesce("of_w", "w").alias("of_w")), "near")
    around = near.select(F.col("w").alias("x"), F.col("of_w").alias("of_x"), F.col("v").alias("mid"))
    met = around.join(near, (F.col("mid") == F.col("v")) & (F.col("x") < F.col("w")) & (F.col("of_x") != F.col("of_w"))).select(F.col("x").alias("a"), F.col("w").alias("b"))
    fresh = met.distinct().join(lists.select("a", "b"), ["a", "b"], "left_anti")
    own = reps.select("rep", "u")
    paired = fresh.join(own.withColumnsRenamed({"rep": "a", "u": "ua"}), "a").join(own.withColumnsRenamed({"rep": "b", "u": "ub"}), "b")
    return paired.select("a", "b", "ua", "ub").mapInArrow(released(_similar(floor, threshold)), PAIRS)


def _audit(reps: DataFrame, classes: DataFrame, threshold: float) -> tuple[int, int, bool]:
    """(links of sampled vertices by brute force, those whose ends are connected, whether the evidence is enough).

    The sample grows fourfold until it has seen EVIDENCE links, holds MOST_AUDITED vertices, or holds all.
    """
    n, most = reps.count(), AUDIT
    while True:
        sample = reps.orderBy(F.xxhash64(F.lit(5), "rep"), "rep").limit(most).select("rep", "label", "u").collect()
        by: dict = {}
        for r in sample:
            by.setdefault((r.label, len(r.u)), []).append((r.rep, r.u))
        blocks = {key: (np.array([i for i, _ in rows], np.int64), _matrix([u for _, u in rows])) for key, rows in by.items()}

        def run(batches, blocks=blocks):
            for batch in small(batches, 1024):
                for rep, label, u in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    if (label, len(u)) in blocks:
                        ids, m = blocks[label, len(u)]
                        hit = ids[(m @ np.frombuffer(u, "<f8") >= threshold) & (ids != rep)]
                        if len(hit):
                            yield _pairs(np.full(len(hit), rep), hit, np.ones(len(hit)), np.ones(len(hit), bool))

        true = cut(reps.select("rep", "label", "u").mapInArrow(released(run), PAIRS).select("a", "b").distinct(), "audit")
        total = true.count()
        if total >= EVIDENCE or most >= min(n, MOST_AUDITED):
            break
        most *= 4
    named = true.join(classes.withColumnsRenamed({"node": "a", "component": "x"}), "a", "left").join(classes.withColumnsRenamed({"node": "b", "component": "y"}), "b", "left")
    return total, named.where("x = y").count(), total >= EVIDENCE or most >= n


def _every_block(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges that connect whatever links, from every block of a label against every other: exact, whatever it costs."""
    cells = deal_into_cells(reps.select("label", F.octet_length("u").alias("size"), "rep", "u"), ["label", "size"], "rep", 2 * CELL)
    dealt = cells.select("cell", "rep", "u").repartition(parts(reps), "cell").sortWithinPartitions("cell")

    def found(ids, units):
        ids = np.array(ids, np.int64)
        a, b = _spanning(_matrix(units), threshold)
        yield _pairs(ids[a], ids[b], np.full(len(a), threshold), np.ones(len(a), bool))

    return dealt.mapInArrow(released(lambda batches: _cells(batches, found)), PAIRS).select("a", "b")


def _counted(reps: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(rep, others): of every vertex that is connected, the rows of the vectors that it links to, counted in blocks."""
    member = reps.join(classes, F.col("rep") == F.col("node")).select("component", F.octet_length("u").alias("width"), "label", "rep", "u", "size")
    sizes = member.groupBy("component", "width").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * CELL)).cast("int").alias("c")).select(F.struct("component", "width").alias("of"), "c")
    dealt = member.join(sizes, F.struct("component", "width") == F.col("of")).withColumn("mine", F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("c")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cell = F.xxhash64("component", "width", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell")
    rows = paired.select(cell, "rep", "u", "size", (F.col("mine") <= F.col("other")).alias("low"), (F.col("mine") == F.col("other")).alias("own"))

    def found(ids, units, sizes, low, own):
        ids, m, sizes, low = np.array(ids, np.int64), _matrix(units), np.array(sizes, np.int64), np.array(low)
        if own[0]:  # one block with itself
            sides = [(m, m, sizes, ids)]
        else:
            sides = [(m[low], m[~low], sizes[~low], ids[low]), (m[~low], m[low], sizes[low], ids[~low])]
        for one, two, weights, names in sides:
            for lo in range(0, len(one), 512):
                hit = one[lo : lo + 512] @ two.T >= threshold
                if own[0]:
                    hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
                yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 512]), pa.array(hit @ weights)], ["rep", "others"])

    dealt = rows.repartition(parts(reps), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(released(lambda batches: _cells(batches, found)), "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, k: int = K,
    most_tries: int = 4, tables: int = TABLES, recall: float = RECALL,
) -> tuple[DataFrame, float | None]:
    """((id, n_links, component, kept) per input row, recall of the audited links; None if too few were seen to tell).

    Rows are compared only within equal, non-null labels. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, nor do rows with a null
    id (component null); vectors of unlike lengths don't link. Copies count as links of
    each other. Rows that share an id are each listed. Ids that are not whole numbers are
    numbered in their order. An empty table gives none. If ``recall`` is not reached after
    ``most_tries`` times ``tables`` tables, all blocks are compared, and recall is 1.
    """
    if not whole_numbers(df, id_col):
        share: list = []

        def find(numbered: DataFrame) -> DataFrame:
            found, got = near_duplicates(numbered, "number", vector_col, label_col, threshold, k, most_tries, tables, recall)
            share.append(got)
            return found

        return by_number(df, id_col, find), share[0]
    columns = [F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")]
    kind = df.schema[label_col].dataType.simpleString()
    rows = cut(df.select(*columns).mapInArrow(released(_unit), f"id long, label {kind}, u binary"), "units")
    reps = cut(rows.where("id is not null and u is not null").groupBy("label", "u").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "vertices")
    if reps.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # an id with several vectors names several vertices: these are numbered, in the order of their ids
        whole = F.struct("rep", "label", "u")
        numbers = numbered_ids(reps.select(whole.alias("vertex")), "vertex").withColumnRenamed("id", "vertex")
        reps = cut(reps.join(numbers, whole == F.col("vertex")).select("label", "u", "size", F.col("number").alias("rep"), F.col("rep").alias("first")), "vertices")
    else:
        reps = reps.withColumn("first", F.col("rep"))
    floor = min(FLOOR, threshold)
    lists = forest = classes = measured = None
    for attempt in range(most_tries):
        made = cut(_buckets(reps, attempt * tables, tables, threshold, k, floor), "buckets")
        lists, forest, classes = _gathered(made, lists, forest, threshold, k, 1)
        for turn in range(8):
            more = cut(_refined(reps, lists, classes, min(2 << turn, WIDE), threshold, k, floor), "round")
            linked = more.where("kept").limit(1).count()
            lists, forest, classes = _gathered(more, lists, forest, threshold, k, min(2 << turn, WIDE), classes if not linked else None)
            if not linked:
                break
        true, got, enough = _audit(reps, classes, threshold)
        measured = got / true if true and enough else 1.0 if enough else None
        if measured is not None and measured >= recall:
            break
    else:
        if measured is not None:
            classes, measured = cut(components(forest.unionByName(_every_block(reps, threshold))), "classes"), 1.0
    counts = _counted(reps, classes, threshold)
    named = (
        reps.join(counts, "rep", "left")
        .join(classes, F.col("rep") == F.col("node"), "left")
        .select("label", "u", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("of"))
        .join(reps.select(F.col("rep").alias("of"), F.col("first").alias("component")), "of")
        .drop("of")
    )
    joined = rows.join(named, ["label", "u"], "left")
    linked = F.col("id").isNotNull() & F.col("component").isNotNull()
    out = joined.select("id", F.when(linked, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.col("component")).otherwise(F.col("id")).alias("component"))
    return out.withColumn("kept", F.col("id") == F.col("component")), measured


def _gathered(found: DataFrame, lists: DataFrame | None, forest: DataFrame | None, threshold: float, k: int, wide: int, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lists trimmed to what the next round looks at, forest, its classes) with what was found."""
    plain = found.select("a", "b", "sim")
    every = plain if lists is None else plain.unionByName(lists)
    best = every.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    kept = _trimmed(cut(best, "pairs"), min(2 * wide, WIDE), threshold, k)
    lists = cut(kept.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"), "sim").distinct(), "lists")
    edges = found.where("kept").select("a", "b")
    forest = cut(edges if forest is None else edges.unionByName(forest), "forest")
    return lists, forest, classes if classes is not None else cut(components(forest), "classes")
