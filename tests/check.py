"""Run registered queries against their SQL twins: python tests/check.py [pattern] [sf]."""

import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

from lapwing.session import build_session  # noqa: E402


def main() -> int:
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf = sys.argv[2] if len(sys.argv) > 2 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("check", cores=8)
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if not re.search(pattern, name):
            continue
        begin = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problems = compare(df, con, oracles[name])
            else:
                problems = [] if df.count() else ["empty result"]
                name += " (no twin)"
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1200]}"]
        took = time.time() - begin
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {took:.1f}s", *problems, sep="\n  " if problems else " ", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
