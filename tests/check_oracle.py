"""Run registered queries against their SQL: python tests/check_oracle.py [folder] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402

from tablelens.session import local_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
queries, sql = entry.queries(), entry.oracle_sql()
names = sys.argv[2:] or list(queries)
spark, con = local_session(), connect(folder)
bad = 0
for name in names:
    start = time.time()
    try:
        df = queries[name](spark, folder)
        problems = compare(df, con, sql[name]) if name in sql else []
        note = "" if name in sql else f"rows only: {df.count()}"
    except Exception as e:
        problems, note = [f"{type(e).__name__}: {str(e)[:600]}"], ""
    bad += bool(problems)
    print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s {note} {' ; '.join(problems)[:900]}", flush=True)
print("bad:", bad, "of", len(names), "without sql:", [n for n in queries if n not in sql])
