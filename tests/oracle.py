"""Run a registered query and its SQL, and compare every value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(row[i] for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(spark, con, name, query, sql, sf) -> list[str]:
    start = time.time()
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    mid = time.time()
    rel = con.sql(sql)
    want, want_names, want_types = rel.fetchall(), rel.columns, [str(t) for t in rel.types]
    end = time.time()
    faults = []
    if sorted(df.columns) != sorted(want_names):
        return [f"columns {sorted(df.columns)} vs {sorted(want_names)}"]
    kinds = dict(zip(want_names, want_types))
    alike = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    for c, t in df.dtypes:
        if alike.get(t) != kinds[c]:
            faults.append(f"type of {c}: {t} vs {kinds[c]}")
    if len(got) != len(want):
        faults.append(f"rows {len(got)} vs {len(want)}")
    a, b = canonical(got, df.columns), canonical(want, want_names)
    wrong = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
    if wrong:
        faults.append(f"{len(wrong)} of {len(a)} rows differ on {sorted(df.columns)}, e.g. {wrong[0]}")
    print(f"{'ok  ' if not faults else 'FAIL'} {name} rows={len(got)} "
          f"spark={mid - start:.1f}s sql={end - mid:.1f}s", *faults, sep="\n     " if faults else " ",
          flush=True)
    return faults


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    folder = sys.argv[1]
    chosen = sys.argv[2:]
    session, con = make_session(), connect(folder)
    failed = 0
    for name, fn in queries().items():
        if chosen and name not in chosen:
            continue
        try:
            if name in oracle_sql():
                failed += bool(compare(session, con, name, fn, oracle_sql()[name], folder))
            else:
                start = time.time()
                n = fn(session, folder).count()
                print(f"rows {name} rows={n} spark={time.time() - start:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            failed += 1
            print(f"FAIL {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("failed:", failed)
