"""Compare every registered query with its SQL: python tests/check_all.py [folder] [name ...]"""

import sys
import time

sys.path.insert(0, ".")
sys.path.insert(0, "tests")

from compare import database, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tabella.session import local_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args or any(a in n for a in args)]
    spark = local_session(8)
    con = database(folder)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, folder)
            note = difference(df, con, sql[n]) if n in sql else f"rows only: {df.count()} {df.columns[:6]}"
            ok = n not in sql or not note
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {n:28s} {time.time() - t0:6.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
