"""Compare every registered query with its DuckDB oracle on one scale factor.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

Checks row count, column names and the order-insensitive multiset of rows
(floats compared at 9 significant digits).  Also importable from pytest.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return v
    return v


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    con.execute("SET TimeZone='UTC'")
    return con


SPARK_TO_DUCK = {
    "IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
    "BooleanType": "BOOLEAN", "TimestampType": "TIMESTAMP WITH TIME ZONE", "TimestampNTZType": "TIMESTAMP",
    "FloatType": "FLOAT", "ShortType": "SMALLINT", "DateType": "DATE",
}


def type_mismatches(sdf, rel):
    """Columns whose Spark type does not map to the DuckDB result type."""
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for f in sdf.schema.fields:
        want = SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__)
        got = duck.get(f.name)
        if got is not None and got != want:
            out.append(f"{f.name}: spark {f.dataType.simpleString()} vs duckdb {got}")
    return out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    rel = con.sql(sql)
    d_cols = rel.columns
    types = type_mismatches(sdf, rel)
    d_rows = [tuple(_norm(x) for x in r) for r in rel.fetchall()]
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "spark_s": round(t1 - t0, 2)}
    if sorted(s_cols) != sorted(d_cols):
        res.update(ok=False, why=f"columns {s_cols} vs {d_cols}")
        return res
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    cs, cd = Counter(map(repr, s_rows)), Counter(map(repr, d_rows))
    if cs != cd:
        only_s = [x[:300] for x in list((cs - cd).elements())[:3]]
        only_d = [x[:300] for x in list((cd - cs).elements())[:3]]
        res.update(ok=False, why=f"spark-only {only_s} | oracle-only {only_d}")
        return res
    if types:
        res.update(ok=False, why=f"types {types}")
        return res
    res["ok"] = True
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from pagemill.session import get_session
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # report and continue
            r = {"name": name, "ok": False, "why": f"{type(exc).__name__}: {str(exc)[:400]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
