"""Run a registered query and its SQL on the same files and compare all values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def table(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def differences(spark, con, name: str, sf_dir: str) -> list[str]:
    df = entry.queries()[name](spark, sf_dir)
    left = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    right = table([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return [f"columns {sorted(set(left[0]) ^ set(right[0]))}"]
    out = []
    if len(left[1]) != len(right[1]):
        out.append(f"rows {len(left[1])} / {len(right[1])}")
    for a, b in zip(left[1], right[1]):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            cells = [f"{c}: {x!r} / {y!r}" for c, x, y in zip(left[0], a, b) if x != y or type(x) is not type(y)]
            out.append("; ".join(cells)[:600])
        if len(out) >= 3:
            break
    return out


if __name__ == "__main__":
    from renewlens.session import local_session

    spark = local_session(8)
    sf = sys.argv[1]
    con = duck(sf)
    for query in sys.argv[2:] or list(entry.oracle_sql()):
        start = time.time()
        try:
            found = differences(spark, con, query, sf)
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        print("OK  " if not found else "DIFF", f"{time.time() - start:6.1f}s", query, *found, sep="  ", flush=True)
