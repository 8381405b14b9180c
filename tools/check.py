"""Run registered queries against their SQL oracles in DuckDB.

usage: python tools/check.py [--sf DIR] [--only a,b] [--show N]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

# Spark type -> the DuckDB types that mean the same.
SAME = {"string": {"VARCHAR"}, "int": {"INTEGER"}, "bigint": {"BIGINT"}, "double": {"DOUBLE"}, "date": {"DATE"},
        "boolean": {"BOOLEAN"}, "timestamp": {"TIMESTAMP", "TIMESTAMP WITH TIME ZONE"}, "float": {"FLOAT"}}


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    return repr(v)


def compare(df, con, sql: str, show: int = 2) -> list[str]:
    """Differences between a DataFrame and the oracle; empty when names, types and rows agree."""
    names = sorted(df.columns)
    cur = con.execute(sql)
    o_names = [d[0] for d in cur.description]
    o_types = {d[0]: str(d[1]) for d in cur.description}
    o_rows = cur.fetchall()
    if names != sorted(o_names):
        return [f"columns {names} vs {sorted(o_names)}"]
    out = []
    for name, kind in df.dtypes:
        if kind in SAME and o_types[name] not in SAME[kind]:
            out.append(f"type of {name}: {kind} vs {o_types[name]}")
    at = [o_names.index(n) for n in names]
    mine = sorted(tuple(_plain(v) for v in r) for r in df.select(*names).collect())
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in o_rows)
    if len(mine) != len(theirs):
        out.append(f"rows {len(mine)} vs {len(theirs)}")
    if mine != theirs:
        left, right = set(mine) - set(theirs), set(theirs) - set(mine)
        out.append(f"values differ: {len(left)} only in Spark, {len(right)} only in SQL; columns {names}")
        out += [f"  spark {r}"[:500] for r in sorted(left)[:show]] + [f"  sql   {r}"[:500] for r in sorted(right)[:show]]
    return out


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--show", type=int, default=2)
    args = ap.parse_args()
    from voxmart.plans import registry
    from voxmart.session import build_session, clear_scratch

    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.sql.artifact.isolation.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = registry.load()
    wanted = [w for w in args.only.split(",") if w]
    con, bad = oracle_connection(args.sf), 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, args.sf)
            if name in oracles:
                diff = compare(df, con, oracles[name], args.show)
                note = "ok" if not diff else "DIFF " + "\n    ".join(diff)
            else:
                note, diff = f"rows only: {df.count()}", []
        except Exception as e:
            text = str(e).split("JVM stacktrace")[0]
            diff, note = ["error"], "ERROR " + type(e).__name__ + " " + text[:700]
        bad += bool(diff)
        print(f"{name:34s} {time.time() - t:6.2f}s {note}", flush=True)
    clear_scratch(spark)
    print(f"{bad} with differences")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
