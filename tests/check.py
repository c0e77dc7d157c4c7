"""Command line: python tests/check.py [folder] [name-prefix ...] compares queries with their SQL."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry
from ledgerlens.session import build_session, release
from tests.compare import compare, oracle_connection


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(folder)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            problem, spent, rows = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as error:
            problem, spent, rows = f"{type(error).__name__}: {str(error)[:900]}", 0.0, 0
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {rows:8d} rows {spent:6.2f}s{'' if name in oracles else ' (no SQL)'}", flush=True)
        if problem:
            bad.append(name)
            print("   " + problem, flush=True)
    print("bad:", bad)
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
