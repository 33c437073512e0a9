"""Helpers that the training-data operators share.

Intermediate tables are written to the folder that ``spark.checkpoint.dir`` names,
which every executor and the driver can read; nothing is kept in a machine's own
temporary folder, so a lost executor costs a retry of its tasks and no data.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one is made only where none is set (tests, local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="chronofold-"))
    return _local[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[list[str]] = []  # the paths of each open scratch


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    for paths in _written:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What ``cut`` writes inside is removed at the end, but for what is handed to the function that this gives."""
    paths: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 1)[0] for f in df.inputFiles())
        kept.update(paths[-1:])  # a table without rows has no files
        return df

    _written.append(paths)
    try:
        yield keep
    finally:
        _written[:] = [p for p in _written if p is not paths]
        for path in paths:
            if path.rsplit("/", 1)[1] not in {k.rsplit("/", 1)[1] for k in kept}:  # names are unique
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def text_of(column: str = "text") -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def give_back() -> None:
    """Return freed memory of this process to the system: workers are reused and would hold the largest task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, with its worker's freed memory given back at the end of each task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def parts(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_numbers(df: DataFrame, id_col: str) -> bool:
    return df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")


def numbered_ids(df: DataFrame, id_col: str) -> DataFrame:
    """(id, number): the distinct ids that are not null, numbered from 0 in their order, dealt by ranges."""
    ids = df.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    dealt = cut(ids.repartitionByRange(parts(df), "id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()), "ids")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    heads = dealt.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = heads.select("part", (before - F.col("first")).alias("shift"))  # a row per partition
    return cut(dealt.join(F.broadcast(offsets), "part").select("id", (F.col("at") + F.col("shift")).alias("number")), "numbers")


def by_number(df: DataFrame, id_col: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``find`` gives for numbers in place of the ids, with the ids in their place again."""
    numbers = numbered_ids(df, id_col)
    plain = df.withColumnRenamed(id_col, "id").drop("number") if id_col != "id" else df.drop("number")
    found = find(plain.join(by_sort(numbers), "id", "left"))
    named = found.withColumnRenamed("id", "number").join(by_sort(numbers), "number", "left").drop("number")
    return named.withColumnRenamed("component", "number").join(by_sort(numbers.withColumnRenamed("id", "component")), "number", "left").select("id", *[c for c in found.columns if c != "id"])


def by_sort(df: DataFrame) -> DataFrame:
    """``df`` for a join that is never sent whole to the driver and from there to every executor.

    Spark goes by the size of files and of columns, which says nothing of the rows that an
    explode makes of them, nor of columns that Parquet packs: a table under its threshold
    for broadcasts can be hundreds of MB there. Sorted joins spill, and hot keys can be split.
    """
    return df.hint("merge")


def deal_into_cells(rows: DataFrame, key: list[str], member: str, most: int) -> DataFrame:
    """Split every key's rows into cells of bounded size in which all pairs of the key still meet.

    Keys with one row are dropped (they have no pair). A key with n rows gets
    c = ceil(n / most) chunks, dealt by the hash of ``member``; each row is sent to
    the c cells that pair its chunk with every chunk, so any two rows share at least
    one cell and no cell holds more than about 2 * most rows. The counts are
    pre-aggregated before their shuffle, and the join on a hot key can be split.
    """
    # a struct isn't what the counts are grouped by: the join's sides get exchanges of their own, and a hot key's can be split
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.struct(*key).alias("_of"), "_n")
    chunks = F.ceil(F.col("_n") / F.lit(most)).cast("int")
    dealt = rows.join(by_sort(counted), F.struct(*key) == F.col("_of")).drop("_of").withColumn("_c", chunks).withColumn("_mine", F.pmod(F.xxhash64(F.lit(7), F.col(member)), F.col("_c")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_c") - 1))
    paired = dealt.withColumn("_other", other)
    cell = F.xxhash64(*key, F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    return paired.withColumn("cell", cell).drop("_n", "_c", "_mine", "_other")


def whole_cells(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Rows that come sorted by their first column, in tables of about ``rows`` that never part a cell."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cells = table.column(0).to_numpy()
        end = int(np.flatnonzero(cells != cells[-1])[-1]) + 1 if cells[0] != cells[-1] else 0
        if end:
            yield table.slice(0, end)
        held = table.slice(end).to_batches()
        n = table.num_rows - end
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
