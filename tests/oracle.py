"""Run registered queries against their SQL form: ``python tests/oracle.py [-s SF] [name-prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def kind(s: pd.Series) -> str:
    k = s.dtype.kind
    if k == "O":
        v = s.dropna()
        if len(v) == 0:
            return "?"
        return "b" if isinstance(v.iloc[0], (bool, np.bool_)) else type(v.iloc[0]).__name__
    return {"u": "i"}.get(k, k)


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(pdf.columns):
        s = pdf[c]
        if kind(s) in ("f", "i", "Decimal", "int", "float"):
            s = s.astype(float).round(6)
        elif kind(s) in ("b", "bool"):
            s = s.map(lambda v: None if pd.isna(v) else str(bool(v)))
        else:
            s = s.map(lambda v: None if v is None or (isinstance(v, float) and v != v) or v is pd.NaT else str(v))
        out[c] = s
    df = pd.DataFrame(out)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for c in got.columns:
        a, b = kind(got[c]), kind(want[c])
        if a != b and "?" not in (a, b) and not {a, b} <= {"i", "f"} and not {a, b} <= {"b", "bool"}:
            return f"type of {c}: {a} != {b}"
    g, w = canonical(got), canonical(want)
    for c in g.columns:
        if g[c].dtype.kind == "f":
            bad = ~(np.isclose(g[c], w[c], rtol=0, atol=1.5e-6, equal_nan=True) | (g[c] == w[c]))
            exact = ~((g[c] == w[c]) | (g[c].isna() & w[c].isna()))
            if bad.any() or exact.any():
                i = np.flatnonzero(bad | exact)[0]
                return f"{c}: {int(bad.sum())} differ, {int(exact.sum())} not equal of {len(g)}; row {i}: {g.iloc[i].to_dict()} != {w.iloc[i].to_dict()}"
        else:
            bad = ~((g[c] == w[c]) | (g[c].isna() & w[c].isna()))
            if bad.any():
                i = np.flatnonzero(bad)[0]
                return f"{c}: {int(bad.sum())} of {len(g)} differ; row {i}: {g.iloc[i].to_dict()} != {w.iloc[i].to_dict()}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from prismgrid.session import local_session

    sf = "0.01"
    if argv[:1] == ["-s"]:
        sf, argv = argv[1], argv[2:]
    d = f"{DATA}/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(d)
    failed = 0
    sql = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            df = fn(spark, d)
            got = df.toPandas()
            dt = time.time() - t
            t = time.time()
            if name in sql:
                want = con.execute(sql[name]).df()
                msg = compare(got, want)
            else:
                msg = None
            nulls = [c for c in got.columns if len(got) and got[c].isna().all()]
            print(f"{'ok  ' if msg is None else 'FAIL'} {name} rows={len(got)} {dt:.1f}s sql={'%.1fs' % (time.time() - t) if name in sql else 'none'}"
                  + (f" ALLNULL {nulls}" if nulls else "") + (" EMPTY" if len(got) == 0 else ""), flush=True)
            if msg:
                failed += 1
                print("    ", msg[:900], flush=True)
        except Exception as e:  # report and go on
            failed += 1
            lines = [x for x in str(e).splitlines() if x.strip()]
            print(f"ERR  {name}: {type(e).__name__}", *lines[:4], *(lines[-3:] if len(lines) > 8 else []), sep="\n     ", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
