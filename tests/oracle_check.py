"""Runs the registered queries next to their SQL: ``oracle_check.py [sf] [name…]``."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from presslake.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(df, con, sql):
    """Empty text if both sides hold the same rows and columns."""
    got_rows, names = [tuple(r) for r in df.collect()], df.columns
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} but SQL has {sorted(want_names)}"
    order, want_order = sorted(range(len(names)), key=lambda i: names[i]), sorted(range(len(names)), key=lambda i: want_names[i])
    got = sorted(repr(tuple(r[i] for i in order)) for r in got_rows)
    want = sorted(repr(tuple(r[i] for i in want_order)) for r in result.fetchall())
    if got == want:
        return ""
    extra, lacking = set(got) - set(want), set(want) - set(got)
    for a in sorted(extra)[:1]:
        for b in sorted(lacking)[:1]:
            at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 0)
            print("   first difference", a[max(0, at - 40): at + 60], "|", b[max(0, at - 40): at + 60])
    return f"{len(got)} rows, SQL {len(want)}\n   got  {[x[:700] for x in sorted(extra)[:3]]}\n   want {[x[:700] for x in sorted(lacking)[:3]]}"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle-check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            text = difference(df, con, sqls[name]) if name in sqls else ""
            note = "" if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            text = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(text)
        note = text or note
        print(f"{'ok ' if not text else 'BAD'} {name:24} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
