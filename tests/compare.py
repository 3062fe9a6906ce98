"""Compare a Spark query with its oracle SQL in DuckDB, value for value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows) -> list[tuple]:
    def cell(v):
        if isinstance(v, float):
            return ("nan",) if math.isnan(v) else (v + 0.0,)
        return (str(v),) if v is not None else ("\0",)

    return sorted((tuple(cell(v) for v in row) for row in rows), key=repr)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[str, int]:
    """('ok' or what differs, number of rows)"""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = canonical(df.select(*[f"`{n}`" for n in names]).collect())
    if sql is None:
        return ("ok" if got else "no rows"), len(got)
    cur = con.execute(f"select * from ({sql})")
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if sorted(cols) != names:
        return f"columns {names} / {sorted(cols)}", len(got)
    order = [cols.index(n) for n in names]
    want = canonical([tuple(r[i] for i in order) for r in cur.fetchall()])
    notes = [f"{n}:{t}/{kinds[n]}" for n, t in df.dtypes if TYPES.get(t) != kinds[n]]
    if len(got) != len(want):
        return f"{len(got)} rows, oracle {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ: {bad[0]}", len(got)
    return ("ok" if not notes else f"types {notes}"), len(got)


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as contract
    from strataframe.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    oracles = contract.oracle_sql()
    for name, fn in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            verdict, rows = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the other queries
            verdict, rows = f"{type(error).__name__}: {str(error)[:700]}", 0
        mark = "" if name in oracles else " (rows only)"
        print(f"{name:32s} {time.time() - start:6.1f}s {rows:8d} {verdict}{mark}", flush=True)
