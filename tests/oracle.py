"""Run registered queries beside their SQL on the same parquet files and compare the rows.

Command line: ``python tests/oracle.py SF_DIR [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pyarrow as pa  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def _rows(t: pa.Table) -> list[tuple]:
    names = sorted(t.column_names)
    cols = [t.column(n).to_pylist() for n in names]
    return sorted(tuple(map(_cell, r)) for r in zip(*cols))


def _types(t: pa.Table) -> dict[str, str]:
    def plain(x):
        return (str(x).replace("large_", "").replace("[ns]", "[us]").replace("string_view", "string"))
    return {f.name: plain(f.type) for f in t.schema}


def compare(df, con, sql: str) -> list[str]:
    """Differences, empty where the two agree on columns, types and every value."""
    got = df.toArrow()
    want = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"]
    out = []
    if got.num_rows != want.num_rows:
        out.append(f"rows {got.num_rows} != {want.num_rows}")
    gt, wt = _types(got), _types(want)
    out += [f"type {c}: {gt[c]} != {wt[c]}" for c in gt if gt[c] != wt[c]]
    a, b = _rows(got), _rows(want)
    if a != b:
        sa, sb = set(a), set(b)
        left, right = [r for r in a if r not in sb], [r for r in b if r not in sa]
        out.append(f"{len(left)} rows differ, e.g. {sorted(got.column_names)}: {left[:2]} != {right[:2]}")
    return out


def main() -> None:
    import __spark_entry__ as entry
    from gustline.session import build_session

    sf = sys.argv[1]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = []
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            if name in sqls:
                diff = compare(df, con, sqls[name])
                note = "ok" if not diff else "DIFF " + "; ".join(diff)
            else:
                note = f"rows only: {len(df.collect())}"
                diff = []
        except Exception as e:  # noqa: BLE001
            diff, note = ["error"], "ERROR " + str(e)[:1500]
        if diff:
            bad.append(name)
        print(f"{name:28s} {time.time() - t:6.2f}s  {note}", flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; not: {bad}")


if __name__ == "__main__":
    main()
