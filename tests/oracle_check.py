"""Compare registered queries with their SQL on DuckDB: `python tests/oracle_check.py [sf] [names...]`.

`HOT_ROWS=30` in the environment makes every key count as a large one, so the split paths are checked too.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 100000 else str(v)
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    got = df.collect()
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    kinds = {d[0]: str(d[1]).upper() for d in res.description}
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ in {sorted(df.columns)}; first {bad[0]}"
    loose = {n: (t, kinds[n]) for n, t in df.dtypes if not same_kind(t, kinds[n])}
    return f"types {loose}" if loose else None


def same_kind(spark_type: str, duck_type: str) -> bool:
    groups = [
        ({"bigint"}, {"BIGINT"}), ({"int", "smallint", "tinyint"}, {"INTEGER", "TINYINT", "SMALLINT"}), ({"double"}, {"DOUBLE"}),
        ({"string"}, {"VARCHAR", "STRING"}), ({"boolean"}, {"BOOLEAN", "BOOL"}),
    ]
    for s, d in groups:
        if spark_type in s:
            return duck_type in d
    return spark_type.startswith("array") and (duck_type.endswith("[]") or duck_type == "LIST")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from careflow.session import build_session

    extra = {"spark__careflow__hotRows": os.environ["HOT_ROWS"]} if "HOT_ROWS" in os.environ else {}
    spark = build_session("local[8]", **extra, spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for n in [q for q in queries if any(q == x or (x.endswith("*") and q.startswith(x[:-1])) for x in names)]:
        start = time.time()
        try:
            if n in sql:
                problem = compare(spark, connect(sf_dir), n, queries[n], sql[n], sf_dir)
            else:
                problem = None if queries[n](spark, sf_dir).count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {n:28s} {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
