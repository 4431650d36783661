"""Run catalogue queries on Spark and DuckDB and compare: ``python -m acceptance.check [sf_dir] [name-part ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from acceptance import load_all
from acceptance.catalog import CATALOG
from hawkspan.session import local_session


def compare(spark, connection, query, sf_dir):
    started = time.time()
    ours = query.run(spark, sf_dir)
    names = sorted(ours.columns)
    mine = sorted(tuple(str(row[n]) for n in names) for row in ours.collect())
    seconds = time.time() - started
    sql = query.statement()
    if sql is None:
        return "rows-only", len(mine), seconds, ""
    result = connection.execute(sql)
    order = [d[0] for d in result.description]
    theirs = sorted(tuple(str(row[order.index(n)]) for n in names) for row in result.fetchall())
    if mine == theirs:
        return "ok", len(mine), seconds, ""
    ours_set, their_set = set(mine), set(theirs)
    only_mine = [r for r in mine if r not in their_set][:2]
    only_theirs = [r for r in theirs if r not in ours_set][:2]
    return "DIFF", len(mine), seconds, f"{names}\n   spark {len(mine)}: {only_mine}\n   duck  {len(theirs)}: {only_theirs}"


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    load_all()
    spark = local_session(8)
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    bad = 0
    for name, query in CATALOG.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            status, rows, seconds, detail = compare(spark, connection, query, sf_dir)
        except Exception as problem:  # report and go on with the next query
            status, rows, seconds, detail = "ERROR", 0, 0.0, str(problem)[:900]
        bad += status in ("DIFF", "ERROR")
        empty = " EMPTY" if rows == 0 else ""
        print(f"{status:9s} {name:34s} rows={rows}{empty} {seconds:.1f}s {detail}", flush=True)
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
