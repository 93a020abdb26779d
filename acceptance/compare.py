"""Run every registered query against its SQL twin.

    python -m acceptance.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from acceptance.catalog import CHECKS


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, sf: str) -> str | None:
    """None if both forms agree in columns, types of the values and rows."""
    check = CHECKS[name]
    got = check.query(spark, sf)
    mine = _rows(got.columns, [tuple(r) for r in got.collect()])
    if check.sql is None:
        return None if mine else "no rows"
    result = con.execute(check.sql)
    columns = [d[0] for d in result.description]
    theirs = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} / {sorted(columns)}"
    if mine != theirs:
        only = [r for r in mine if r not in set(theirs)][:2]
        missing = [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} / {len(theirs)} rows; only here {only}; missing {missing}"[:1500]
    types = {f.name: f.dataType.simpleString() for f in got.schema}
    sql_types = {d[0]: str(d[1]).upper() for d in result.description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {c: (t, sql_types[c]) for c, t in types.items() if same.get(t) and sql_types[c] not in (same[t], "STRING", "NUMBER")}
    return f"types {wrong}" if wrong else None


if __name__ == "__main__":
    from patchlight.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, bad = local_session(8), connect(sf), 0
    for name in sys.argv[2:] or CHECKS:
        start = time.time()
        try:
            problem = differences(spark, con, name, sf)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        kind = "rows" if CHECKS[name].sql is None else "sql"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} of {len(CHECKS)} differ")
