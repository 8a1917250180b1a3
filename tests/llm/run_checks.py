"""Command line: compare the queries of the subpackage with their check SQL.

python tests/llm/run_checks.py folder [key ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, __file__.rsplit("/", 3)[0])
from tallymark.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from tallymark.session import build_session  # noqa: E402
from tests.llm.compare import differences  # noqa: E402


def main() -> None:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("checks", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": os.environ.get("CHECKPOINT_DIR", "/tmp/checkpoints")})
    spark.sparkContext.setLogLevel("ERROR")
    for key in wanted or QUERIES:
        start = time.time()
        problem = differences(spark, folder, QUERIES[key], ORACLE_SQL.get(key))
        print(key, f"{time.time() - start:.1f}s", problem or "equal", flush=True)


if __name__ == "__main__":
    main()
