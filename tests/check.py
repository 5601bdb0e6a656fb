"""python tests/check.py sf0.01 [key ...]: compare registered queries with their check SQL."""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")

import __spark_entry__ as entry  # noqa: E402
from tests.harness import compare, duck  # noqa: E402
from tracewell.session import local_session  # noqa: E402


def main():
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = sys.argv[2:] or list(queries)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            df = queries[key](spark, sf_dir)
            if key in oracles:
                note = compare(con, df, oracles[key])
                n = df.count() if note is None and "-n" in sys.argv else ""
            else:
                n, note = len(df.collect()), None
        except Exception as e:
            note = f"{type(e).__name__}: {str(e)[:700]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += note is not None
        print(f"{'ok  ' if note is None else 'FAIL'} {key} {time.time() - start:.1f}s {'R' if key not in oracles else ''} {n if note is None else note}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")


main()
