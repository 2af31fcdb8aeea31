"""Runs registered queries and their SQL side by side. As a script: python tests/oracle.py [SF_DIR] [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else v
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    if isinstance(v, list):
        return tuple(map(_plain, v))
    return None if v is None or v is pd.NaT or v is pd.NA else v


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if the rows and columns are equal, else what differs."""
    mine, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    kinds = {c: (str(mine[c].dtype), str(theirs[c].dtype)) for c in mine.columns if mine[c].dtype.kind != theirs[c].dtype.kind and mine[c].notna().any()}
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(different)} rows differ: {different[:2]}" if different else f"types {kinds}" if kinds else ""


def main(argv: list[str]) -> None:
    import __spark_entry__
    from sparkseek.session import session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(cores=4), database(sf_dir)
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in argv[1:] or queries:
        start = time.time()
        try:
            said = compare(spark, con, queries[name], oracles[name], sf_dir) if name in oracles else f"({queries[name](spark, sf_dir).count()} rows, no SQL)"
        except Exception as error:
            said = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {said or 'equal'} {time.time() - start:.1f} s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
