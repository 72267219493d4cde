"""Compare registered queries with their SQL twins. Usage: check.py [sf] [name ...]"""

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twinproof.catalog import ORACLES, QUERIES  # noqa: E402
from twinproof.session import build_session  # noqa: E402


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, int):
            return str(v)
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    out = frame.map(text) if len(frame) else frame
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out) else out


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = df.toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name} {len(got)} {took:.2f}s", flush=True)
                if len(names) == 1:
                    print(got.head(20).to_string())
                continue
            rel = con.execute(ORACLES[name])
            want = rel.df()
            types = {d[0]: str(d[1]) for d in rel.description}
            a, b = plain(got), plain(want)
            kinds = dict(df.dtypes)
            odd = {c: (kinds.get(c), types.get(c)) for c in types if c in kinds
                   and (("DOUBLE" in types[c]) != (kinds[c] == "double") or "DECIMAL" in types[c] or "HUGE" in types[c])}
            same = a.equals(b)
            bad += not same
            print(f"{'ok  ' if same else 'DIFF'} {name} {len(a)}/{len(b)} {took:.2f}s {odd or ''}", flush=True)
            if not same or len(names) == 1:
                if list(a.columns) != list(b.columns):
                    print("  columns", list(a.columns), list(b.columns))
                elif len(a) == len(b):
                    rows = (a != b).any(axis=1)
                    print(a[rows].head(5).to_string(), "\n", b[rows].head(5).to_string())
                else:
                    print(a.head(5).to_string(), "\n", b.head(5).to_string())
                if same:
                    print(a.head(8).to_string())
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {str(e)[:1500]}")
            if len(names) == 1:
                traceback.print_exc()
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
