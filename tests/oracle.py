"""Run registered queries against DuckDB: ``python tests/oracle.py [sf_dir] [name part ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(arrow) -> list[tuple]:
    names = sorted(arrow.column_names)
    rows = list(zip(*[arrow.column(n).to_pylist() for n in names])) if arrow.num_rows else []
    return sorted(rows, key=repr)


def _kind(t) -> str:
    return str(t).replace("large_", "")


def differences(got, want) -> list[str]:
    """What differs between two Arrow tables regardless of row and column order."""
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"]
    out = [
        f"type of {n}: {got.schema.field(n).type} != {want.schema.field(n).type}"
        for n in got.column_names if _kind(got.schema.field(n).type) != _kind(want.schema.field(n).type)
    ]
    a, b = _canonical(got), _canonical(want)
    if len(a) != len(b):
        return out + [f"rows {len(a)} != {len(b)}"]
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        out.append(f"{len(bad)} of {len(a)} rows differ, first {bad[0]}")
    return out


def check(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[list[str], int, float]:
    start = time.time()
    got = fn(spark, sf_dir).toArrow()
    took = time.time() - start
    return (differences(got, con.sql(sql).to_arrow_table()) if sql else []), got.num_rows, took


def main() -> None:
    from agestack.plans import catalog
    from agestack.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    failed = 0
    for name, fn in catalog.QUERIES.items():
        if args and not any(a in name for a in args):
            continue
        try:
            diff, n, took = check(spark, con, sf_dir, name, fn, catalog.SQL.get(name))
        except Exception as error:  # report and go on with the next query
            diff, n, took = [f"{type(error).__name__}: {str(error)[:1500]}"], 0, 0.0
        failed += bool(diff)
        note = "" if name in catalog.SQL else " (rows only)"
        print(f"{'FAIL' if diff else 'ok  '} {name}{note} {n} rows {took:.2f}s", *diff, sep="\n       " if diff else " ", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
