"""Run registered queries against their SQL twins: ``python tests/run_suite.py [folder] [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, differences  # noqa: E402

from tabletrail import suite  # noqa: E402
from tabletrail.plans import release_scratch  # noqa: E402
from tabletrail.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(suite.queries())
    spark = local_session("tabletrail-suite")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles, bad = suite.oracle_sql(), []
    for name in names:
        start = time.time()
        try:
            df = suite.queries()[name](spark, folder)
            outcome = differences(df, connection, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as error:
            traceback.print_exc(limit=-2)
            outcome = f"{type(error).__name__}: {str(error)[:1500]}"
        good = outcome is None or outcome.startswith("rows only")
        bad += [] if good else [name]
        print(f"{'ok ' if good else 'BAD'} {name} {time.time() - start:.2f}s {outcome or ''}", flush=True)
    print("bad:", bad)
    release_scratch(spark)
