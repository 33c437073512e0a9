"""The fold's steps on unbounded input: keyed state in Structured Streaming."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronofold.operators.fold import Step, columns_of, inputs_of, outputs_to


def fold_stream(df: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, start: Callable[[], Any], outputs: str) -> DataFrame:
    """The streaming counterpart of ``fold``: state is kept per key across micro-batches.

    Rows of a key are sorted within a micro-batch; a row that arrives in a later batch than
    its successor is folded late. Put a watermark on ``df`` and drop late rows to avoid it.
    """
    keep = list(dict.fromkeys([key, *order]))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields] + [outputs])
    made = columns_of(outputs)

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else start()
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for row in inputs_of([pa.array(pdf[c], from_pandas=True) for c in inputs]):
            y, now = step(now, row)
            out.append(y)
        state.update((pickle.dumps(now),))
        result = pdf[keep].reset_index(drop=True)
        for (name, _), values in zip(made, outputs_to(out, made)):
            result[name] = values.to_pandas()
        yield result

    return df.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into Parquet files, and give them as a table.

    Files and checkpoint go to ``folder``, by default to a new one under
    ``spark.checkpoint.dir``; only a local session without that setting uses a local one.
    """
    spark = stream.sparkSession
    base = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/drained-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def recorder(stream: DataFrame, record: Callable[[DataFrame, int], None], progress: str):
    """Start a stream that hands every micro-batch to ``record(rows, number)``."""
    return stream.writeStream.foreachBatch(record).option("checkpointLocation", progress).trigger(availableNow=True).start()
