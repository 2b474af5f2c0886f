"""Compare registered queries with their oracle SQL: python -m tests.oracle [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(spark, con, name, query, sql, sf_dir) -> list[str]:
    """Empty when columns, row count and values agree."""
    df = query(spark, sf_dir)
    got = df.collect()
    differences.rows = len(got)
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    left, right = _rows(df.columns, [tuple(r) for r in got]), _rows(columns, expected)
    if len(left) != len(right):
        return [f"rows {len(left)} != {len(right)}"]
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    kinds = [(c, type(a), type(b)) for c, a, b in zip(sorted(columns), left[0], right[0])
             if a is not None and b is not None and type(a) is not type(b)] if left else []
    return [f"{len(bad)} rows differ, e.g.\n   {a}\n   {b}" for a, b in bad[:1]] + [f"type {k}" for k in kinds]


if __name__ == "__main__":
    from souba.plans import all_oracles, all_queries
    from souba.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(cores=8), database(folder)
    names = sys.argv[2:] or list(all_queries())
    failures = 0
    for name in names:
        start = time.time()
        query, sql = all_queries()[name], all_oracles().get(name)
        try:
            if sql is None:
                problems, note = [], f"rows only: {len(query(spark, folder).collect())}"
            else:
                problems, note = differences(spark, con, name, query, sql, folder), ""
                note = f"{differences.rows} rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failures += bool(problems)
        print("@", "FAIL" if problems else "ok  ", name, f"{time.time() - start:.1f}s", note, *problems, flush=True)
    print("@ failures:", failures, "of", len(names))
