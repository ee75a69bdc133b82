"""Run every registered query against its SQL: check_all.py SF_DIR [key ...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from newsloom.session import local_session
from tests import compare

sf, only = sys.argv[1], sys.argv[2:]
spark = local_session(8)
con = compare.connect(sf)
sqls = entry.oracle_sql()
for name, fn in entry.queries().items():
    if only and name not in only:
        continue
    try:
        start = time.time()
        df = fn(spark, sf)
        columns, got = compare.spark_rows(df)
        mid = time.time()
        if name not in sqls:
            print(f"{name:26} rows={len(got)} no SQL {mid - start:.2f}s", flush=True)
            continue
        ocols, want, types = compare.oracle_rows(con, sqls[name])
        same = sorted(columns) == sorted(ocols) and got == want
        print(f"{name:26} {'ok' if same else 'DIFF'} rows={len(got)}/{len(want)} "
              f"spark={mid - start:.2f}s duck={time.time() - mid:.2f}s", flush=True)
        dtypes = dict(df.dtypes)
        pair = {"bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE",
                "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
        odd = {c: (dtypes[c], types.get(c)) for c in columns if pair.get(dtypes[c]) != types.get(c)}
        if odd:
            print("   types", odd)
        if not same:
            print("   spark", sorted(columns), [r for r in got if r not in set(want)][:2])
            print("   duck ", sorted(ocols), [r for r in want if r not in set(got)][:2])
    except Exception as e:
        print(f"{name:26} ERROR {type(e).__name__} {str(e)[:600]}", flush=True)
