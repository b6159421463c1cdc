"""Run every registered query next to its SQL and compare all rows.

    python -m workloads.check [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from ledgerrecon.session import build_session
from workloads.oracles import ORACLES
from workloads.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = sorted_rows(df.columns, df.collect())
            seconds = time.time() - start
            if name not in ORACLES:
                print(f"rows-only {name:28s} {len(got):7d} {seconds:6.2f}s")
                continue
            rel = db.sql(ORACLES[name])
            want = sorted_rows(rel.columns, rel.fetchall())
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"ERROR     {name}: {str(exc)[:900]}")
            continue
        same = sorted(df.columns) == sorted(rel.columns) and got == want
        kinds = dict(zip(rel.columns, map(str, rel.types)))
        print(f"{'ok' if same else 'MISMATCH':9s} {name:28s} {len(got):7d} {seconds:6.2f}s")
        if not same:
            bad += 1
            print("   spark", len(got), sorted(df.dtypes), "\n   sql  ", len(want), sorted(kinds.items()))
            missing, extra = [r for r in want if r not in set(got)][:3], [r for r in got if r not in set(want)][:3]
            print("   only sql:", missing, "\n   only spark:", extra)
    spark.stop()
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
