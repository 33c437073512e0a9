"""Hold every query that has SQL against DuckDB: ``python tests/check_oracles.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, Decimal):
        return round(float(value), 9) + 0.0
    if isinstance(value, (datetime, date)):
        return str(value)[:19]
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def equal(a, b) -> bool:
    """Without a tolerance; only what both sides have rounded to six places may fall on either side of a tie."""
    if a == b:
        return True
    tied = isinstance(a, float) and isinstance(b, float) and round(a, 6) == a and round(b, 6) == b
    return tied and abs(a - b) < 1.01e-6


def same(a: list[tuple], b: list[tuple]) -> bool:
    return len(a) == len(b) and all(len(r) == len(s) and all(map(equal, r, s)) for r, s in zip(a, b))


def compare(spark, sf_dir: str, name: str, query, sql: str) -> str:
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    theirs = rows_of(columns, got.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if not same(ours, theirs):
        odd = next(((a, b) for a, b in zip(ours, theirs) if not same([a], [b])), None)
        return f"{len(ours)} and {len(theirs)} rows; first difference {odd}"
    return ""


def main() -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in sys.argv[2:] or queries:
        if name.startswith(("op", "pipeline")) and not sys.argv[2:]:
            continue
        start = time.time()
        try:
            said = compare(spark, sf_dir, name, queries[name], oracles[name]) if name in oracles else f"rows only: {queries[name](spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:500]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'equal'} ({time.time() - start:.1f} s)", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
