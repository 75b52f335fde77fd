"""Run registered queries against their SQL twins: ``python tests/check_queries.py [sf] [names…]``."""

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from storyline.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "~" if math.isnan(v) else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("\x1f".join(cell(r[i]) for i in order) for r in rows)


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    only = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    spark = build_session("local[8]")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time() - start
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: spark {str(exc)[:400]}")
            continue
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {t1:.1f}s (no SQL twin)")
            continue
        start = time.time()
        try:
            res = con.execute(oracles[name])
            cols = [d[0] for d in res.description]
            want = res.fetchall()
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: sql {str(exc)[:400]}")
            continue
        t2 = time.time() - start
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if sorted(df.columns) != sorted(cols):
            bad += 1
            print(f"FAIL {name}: columns {sorted(df.columns)} != {sorted(cols)}")
        elif a != b:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; only spark {len(sa - sb)}, only sql {len(sb - sa)}")
            for x in sorted(sa - sb)[:2]:
                print("   spark:", x[:700].replace("\x1f", " | "))
            for x in sorted(sb - sa)[:2]:
                print("   sql:  ", x[:700].replace("\x1f", " | "))
        else:
            digest = hashlib.md5("\n".join(a).encode()).hexdigest()[:8]
            types = [f.dataType.simpleString() for f in df.schema]
            flag = " NESTED" if any("array" in t or "struct" in t or "map" in t for t in types) else ""
            print(f"ok   {name}: {len(a)} rows {t1:.1f}s / {t2:.1f}s {digest}{flag}")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
