"""Runs queries beside their SQL: python tests/oracle.py [sf] [name ...]"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "").removesuffix("+0")
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def duck(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, con, fn, sql: str, d: str) -> str:
    """'' if the rows of both are the same, else what differs."""
    df = fn(spark, d)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return ""
    return f"rows {sum(got.values())} and {sum(want.values())}; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tracequarry.session import get_spark

    spark = get_spark(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    con = duck(d)
    sql = e.oracle_sql()
    for name, fn in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            said = compare(spark, con, fn, sql[name], d) if name in sql else f"no SQL; {fn(spark, d).count()} rows"
        except Exception as x:
            said = f"ERROR {str(x)[:1500]}"
        print(f"{name}: {said or 'ok'} ({time.time() - t:.1f} s)"[:900], flush=True)
