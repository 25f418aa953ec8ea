"""Compare every query with its SQL twin in DuckDB; also usable as a script."""

from __future__ import annotations

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _text(v):
    if v is None or v != v or str(v) == "NaT":
        return "∅"
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ").removesuffix(" 00:00:00")
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_text(r[i]) for i in order) for r in rows)


def compare(name, df, con, sql):
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = canonical([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{name}: {len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else None


def main(sf: str, only: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tagloom.session import local_session

    spark, sf_dir = local_session(), f"/root/testdata/sf{sf}"
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            note = compare(name, df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            note = f"{name}: {type(e).__name__} {str(e)[:600]}"
        print(f"{time.time() - start:6.2f}s {name:24s} {note or 'ok'}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
