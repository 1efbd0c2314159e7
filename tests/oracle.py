"""Run registered queries and compare them with their SQL in DuckDB.

As a script:  python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    assert got_cols == want_cols, f"columns {got_cols} != {want_cols}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        raise AssertionError(f"{len(got)} rows vs {len(want)}; only spark {extra}; only sql {lack}")
    return len(got)


def test_session():
    from cohortloom.session import build_session

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    spark = build_session("cohortloom-tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.driver.bindAddress": "127.0.0.1", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


test_session.__test__ = False


def main(argv):
    from cohortloom.plans.registry import all_queries

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, bad = test_session(), duck(sf_dir), []
    for name, query in all_queries().items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        t = time.time()
        try:
            if query.sql:
                n = compare(query.run(spark, sf_dir), con, query.sql)
            else:
                n = len(query.run(spark, sf_dir).collect())
            print(f"ok   {name:28s} {n:7d} rows {time.time() - t:6.2f}s{'' if query.sql else '  (rows only)'}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name:28s} {str(e)[:700]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
