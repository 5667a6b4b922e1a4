"""Whole keys against small chunks:  python tests/check_chunks.py FOLDER [BOUND] [names].

Every query is run twice, once with whole keys and once as if no key fitted a task.
"""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from session import local_session, normal  # noqa: E402

from gapwise.ordered import GROUP_ROWS_CONF  # noqa: E402

SAME_EITHER_WAY = ("stream_", "read_", "classify_", "parse_", "write_", "opt_", "json_", "episode_job")


def main(folder, bound, names):
    spark = local_session()
    queries = entry.queries()
    names = names or [n for n in queries if not n.startswith(SAME_EITHER_WAY)]
    bad = 0
    for name in names:
        start, problem, rows = time.time(), "ok", -1
        try:
            results = []
            for rows_per_group in ("2000000", str(bound)):
                spark.conf.set(GROUP_ROWS_CONF, rows_per_group)
                df = queries[name](spark, folder)
                results.append(normal(df.columns, [tuple(r) for r in df.collect()]))
            rows = len(results[0][1])
            if results[0] != results[1]:
                pairs = zip(results[0][1], results[1][1])
                first = next((p for p in pairs if p[0] != p[1]), None)
                problem = f"{rows} != {len(results[1][1])} rows, first {first}"
        except Exception as error:
            problem = "".join(traceback.format_exception_only(error))[:1200]
        bad += problem != "ok"
        print(f"{time.time() - start:6.2f}s {name}: {rows} rows {problem}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 9, sys.argv[3:])
