"""python tests/run_oracles.py [sf] [name part ...]: queries against their SQL, with timings."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as entry  # noqa: E402
from compare import connect, difference  # noqa: E402

from missive.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            found = difference(run(spark, sf_dir), con, sql) if sql else f"{run(spark, sf_dir).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001 - keep going, report at the end
            found = f"{type(error).__name__}: {str(error)[:700]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - started:.1f}s {found or ''}", flush=True)
    print("differences:", bad)


main()
