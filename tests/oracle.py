"""Runs registered queries against their check SQL in DuckDB.

``python tests/oracle.py [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _cell(v.item())
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when rows agree, else what differs first."""
    rel = con.execute(sql)
    sql_names = [d[0] for d in rel.description]
    sql_types = {d[0]: str(d[1]) for d in rel.description}
    want = _rows(sql_names, rel.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(sql_names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_names)}"
    if any("HUGEINT" in t or "DECIMAL" in t for t in sql_types.values()):
        return f"wide types {sql_types}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN"}
    off = {c: (t, sql_types[c]) for c, t in spark_df.dtypes if kinds.get(t) != sql_types[c]}
    if off:
        return f"types {off}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; extra {extra}; missing {lost}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sorted(sql_names)}: {a} != {b}"
    return None


def main(names: list[str]) -> int:
    import __spark_entry__ as e
    from reelgrid.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = e.queries(), e.oracle_sql()
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                problem = difference(df, con, sql[name])
                n = ""
            else:
                problem, n = None, f"(rows only: {df.count()})"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
            n = ""
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {n}",
              problem or "", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
