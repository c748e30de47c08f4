"""Command line: python -m tests.check_oracle [scale factor] [query ...]"""

from __future__ import annotations

import sys
import time

from tests.oracle import SF_ROOT, compare, connect
from tidewatch.plans.oracle import all_sql
from tidewatch.plans.queries import all_queries
from tidewatch.session import local_session


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = str(SF_ROOT / f"sf{scale}")
    queries, sql = all_queries(), all_sql()
    names = sys.argv[2:] or list(queries)
    spark = local_session()
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems = compare(queries[name](spark, sf_dir), connection, sql[name])
        except Exception as error:  # report the query and go on
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", *problems, sep="\n     " if problems else " ")
    print(f"{len(names) - failed} of {len(names)} agree; without SQL: {sorted(set(queries) - set(sql))}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
