"""Command line check: python tests/check_oracle.py [folder] [name-prefix ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerlens.plans.catalog import QUERIES  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(folder)
    bad = 0
    for name, q in QUERIES.items():
        if wanted and not any(name.startswith(w) or q.run.__module__.endswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if q.sql:
                diff, n = compare(spark, con, q, folder)
            else:
                diff, n = "", len(q.run(spark, folder).collect())
                diff = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        if diff:
            bad += 1
        print(f"{'ok ' if not diff else 'BAD'} {name:32s} rows={n:<7d} {time.time()-t:5.1f}s {'' if q.sql else '(rows only)'} {diff}", flush=True)
    print(f"{bad} differences")


if __name__ == "__main__":
    main()
