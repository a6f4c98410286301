"""Every query against its SQL: ``python -m tests.check_all [folder] [name ...]``."""

from __future__ import annotations

import sys
import time

import __spark_entry__ as entry
from quayside.session import build_session
from tests.compare import connect, differences


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            found = differences(df, con, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as error:
            found = f"ERROR {str(error)[:600]}"
        good = found is None or found.startswith("rows only")
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - start:.2f}s {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
