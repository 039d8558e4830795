"""Compares queries with their SQL: ``python tests/parity.py FOLDER [NAME...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(folder: str):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"create view {p.stem} as select * from '{p if p.is_file() else str(p) + '/*.parquet'}'")
    return con


def canonical(rows: list[tuple], digits: int = 6) -> list[str]:
    def one(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{round(v, digits) + 0.0:.{digits}g}" if v else "0"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(one(x) for x in v) + "]"
        return str(v)

    return sorted("|".join(one(v) for v in r) for r in rows)


def difference(spark, con, folder: str, query, sql: str) -> str:
    """Empty if both give the same rows."""
    got = query(spark, folder)
    cols = sorted(got.columns)
    want = con.sql(sql)
    if sorted(want.columns) != cols:
        return f"columns {cols} and {sorted(want.columns)}"
    a = canonical([tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()])
    b = canonical(want.select(*[f'"{c}"' for c in cols]).fetchall())
    if a == b:
        return ""
    x, y = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} and {len(b)} rows; only here {x[:3]}, only SQL {y[:3]} ({len(x)}, {len(y)})"


def main(folder: str, *names: str) -> int:
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    sql = e.oracle_sql()
    for k, f in e.queries().items():
        if names and not any(k.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            said = difference(spark, con, folder, f, sql[k]) if k in sql else f"rows only: {f(spark, folder).count()}"
            bad += bool(said) and k in sql
        except Exception as x:  # noqa: BLE001
            said, bad = f"ERROR {str(x)[:1200]}", bad + 1
        print(f"{k}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
        spark.catalog.clearCache()
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
