"""Run registered queries next to their SQL in DuckDB and compare every value.

``python -m tests.compare [name-part ...]`` prints one line per query; ``SF_DIR`` picks the data.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order and values in one spelling, sorted."""

    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, (bool,)):
            return str(bool(x))
        if isinstance(x, pd.Timestamp) or hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        if isinstance(x, float):
            return repr(x)
        if hasattr(x, "item"):
            return value(x.item())
        return str(x)

    columns = sorted(pdf.columns)
    cast = [pdf[c].astype(object).tolist() for c in columns]
    return sorted(tuple(value(x) for x in row) for row in zip(*cast))


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} against {sorted(sql_pdf.columns)}"
    for c in spark_pdf.columns:
        kinds = [_kind(df[c]) for df in (spark_pdf, sql_pdf)]
        if kinds[0] != kinds[1] and len(spark_pdf):
            return f"column {c}: {spark_pdf[c].dtype} against {sql_pdf[c].dtype}"
    left, right = canonical(spark_pdf), canonical(sql_pdf)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {a} against {b}"
    return None


def _kind(s: pd.Series) -> str:
    kind = s.dtype.kind
    return {"i": "n", "u": "n", "f": "n", "O": "o"}.get(kind, kind) if kind != "O" or s.notna().any() else "n"


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import local_session

    sf_dir = os.environ.get("SF_DIR", DEFAULT_SF_DIR)
    spark = local_session()
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if sys.argv[1:] and not any(part in name for part in sys.argv[1:]):
            continue
        started = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - started
            if name in oracles:
                problem = differences(got, con.execute(oracles[name]).df())
            else:
                problem = None
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            problem, took, got = f"{type(error).__name__}: {str(error)[:700]}", time.time() - started, []
        bad += problem is not None
        status = "ok" if problem is None else "DIFF"
        print(f"{status:5}{name:28}{len(got):8} rows {took:6.2f}s {'' if name in oracles else '(no SQL)'} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
