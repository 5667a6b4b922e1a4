"""Compare registered queries with their SQL:  python tests/check_queries.py FOLDER [names]."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from session import compare, duck, local_session  # noqa: E402


def main(folder, names):
    spark, con = local_session(), duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                rows, problem = compare(spark, con, queries[name], oracles[name], folder)
            else:
                rows, problem = queries[name](spark, folder).count(), None
        except Exception as error:
            rows, problem = -1, "".join(traceback.format_exception_only(error))[:1500]
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{time.time() - start:6.2f}s {kind} {name}: {rows} rows {problem or 'ok'}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
