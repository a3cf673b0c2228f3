"""Run registered queries next to their SQL twin and compare types and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def bag(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


def differences(df, con, sql: str) -> list[str]:
    names = sorted(df.columns)
    out = con.execute(sql)
    described = {d[0]: str(d[1]) for d in out.description}
    rows = out.fetchall()
    if sorted(described) != names:
        return [f"columns {names} != {sorted(described)}"]
    found = []
    for name, kind in df.dtypes:
        if SAME_TYPE.get(kind) != described[name]:
            found.append(f"type of {name}: {kind} != {described[name]}")
    order = [list(described).index(n) for n in names]
    want = bag(tuple(r[i] for i in order) for r in rows)
    got = bag(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    if len(want) != len(got):
        found.append(f"rows: {len(got)} != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        found.append(f"{len(bad)} rows differ, first: {bad[0][0]} != {bad[0][1]}")
    return found


def main(folder: str, names: list[str]):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark = make_session()
    con = connect(folder)
    queries, twins = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            if name in twins:
                found = differences(df, con, twins[name])
            else:
                found = [f"no twin, {len(df.collect())} rows"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{name:26s} {time.time() - started:6.2f}s {'ok' if not found else found}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
