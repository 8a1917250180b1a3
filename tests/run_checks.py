"""Command line: compare registered queries with their check SQL, with times.

python tests/run_checks.py [folder] [key ...]
"""

from __future__ import annotations

import sys
import tempfile
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from tallymark.registry import oracle_sql, queries  # noqa: E402
from tallymark.session import build_session  # noqa: E402
from tests.compare import check_connection, compare  # noqa: E402


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("checks", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
                                                   "spark.checkpoint.dir": tempfile.mkdtemp(prefix="checks-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = check_connection(folder)
    wanted = [a for a in sys.argv[2:]]
    keys = [k for k in queries() if not wanted or k in wanted or any(w.endswith("*") and k.startswith(w[:-1]) for w in wanted)]
    failed = []
    for key in keys:
        start = time.time()
        try:
            problem = compare(spark, folder, key, con)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
            if "-v" in wanted:
                traceback.print_exc()
        mark = "ok  " if problem is None else "FAIL"
        sql = "" if key in oracle_sql() else " (rows only)"
        print(f"{mark} {key} {time.time() - start:.2f}s{sql} {problem or ''}", flush=True)
        if problem:
            failed.append(key)
    print(f"{len(keys) - len(failed)} of {len(keys)} equal; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
