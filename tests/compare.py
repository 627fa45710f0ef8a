"""Run a query in Spark and its oracle in DuckDB on the same folder and compare them value by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return str(value) if not isinstance(value, (int, bool)) else value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def spark_rows(df):
    names = sorted(df.columns)
    return names, _sorted([tuple(_plain(v) for v in r) for r in df.select(*names).collect()])


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    picks = [rel.columns.index(n) for n in names]
    rows = rel.fetchall()
    return names, _sorted([tuple(_plain(r[i]) for i in picks) for r in rows]), dict(zip(rel.columns, map(str, rel.types)))


#: Spark type -> DuckDB type of the same pandas representation
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def differences(df, con, sql) -> list[str]:
    names, got = spark_rows(df)
    other, want, types = duck_rows(con, sql)
    out = []
    if names != other:
        return [f"columns {names} != {other}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind) != types[name]:
            out.append(f"type of {name}: {kind} != {types[name]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first: spark {bad[0][0]} duck {bad[0][1]}")
    if not want:
        out.append("oracle is empty")
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from gridcast.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("compare", cores=8, partitions=8)
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                found = differences(df, con, oracles[name])
                rows = ""
            else:
                rows = f" {len(df.collect())} rows only"
                found = []
        except Exception as exc:  # report and go on with the next query
            found, rows = [f"{type(exc).__name__}: {str(exc)[:1500]}"], ""
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok'} {name} {time.time() - started:.1f}s{rows}", *found, sep="\n   ", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
