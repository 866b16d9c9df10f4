"""Run registered queries beside their SQL and compare the results.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canon(value):
    if value is None or type(value).__name__ in ("NAType", "NaTType"):
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.9g}")
    if hasattr(value, "item"):
        return canon(value.item())
    if hasattr(value, "isoformat"):
        return str(value)
    return value


def rows_of(pdf):
    cols = sorted(pdf.columns)
    data = zip(*[[canon(v) for v in pdf[c].tolist()] for c in cols]) if len(pdf) else []
    return cols, sorted(data, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def check(spark, con, sf: str, name: str, fn, sql: str | None) -> str:
    t0 = time.time()
    got = fn(spark, sf).toPandas()
    took = time.time() - t0
    note = f"{name}: {len(got)} rows, spark {took:.1f}s"
    if sql is None:
        return f"OK   {note} (no sql)"
    t0 = time.time()
    want = con.execute(sql).df()
    note += f", duckdb {time.time() - t0:.1f}s"
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    if gc != wc:
        return f"FAIL {note}: columns {gc} vs {wc}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in gc}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if gr != wr:
        diff = [(a, b) for a, b in zip(gr, wr) if a != b][:2]
        return f"FAIL {note}: {len(gr)} vs {len(wr)} rows; {str(diff)[:1500]}"
    if len(gr) == 0:
        return f"EMPTY {note}"
    return f"OK   {note}" + (f" dtype {odd}" if odd else "")


def session():
    from tarn import get_session

    spark = get_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tarn-compare-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    QUERIES, ORACLES = queries(), oracle_sql()
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    names = [n for n in QUERIES if not argv or any(n.startswith(a) for a in argv)]
    spark, con, bad = session(), duck(sf), 0
    for name in names:
        try:
            line = check(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # report and go on with the other queries
            line = f"FAIL {name}: {type(e).__name__} {str(e)[:1200]}"
        bad += not line.startswith("OK")
        print(line, flush=True)
    print(f"{len(names)} queries, {bad} not ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
