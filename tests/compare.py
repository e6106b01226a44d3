"""Run a query in Spark and its SQL in DuckDB on the same tables and compare the rows.

As a script: python tests/compare.py sf0.01 [names...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def canon(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, make, sql: str, folder: str) -> str:
    """Empty when both sides agree."""
    df = make(spark, folder)
    mine = canon(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = canon(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(mine) != len(want):
        return f"{len(mine)} rows against {len(want)}: {mine[:3]} / {want[:3]}"
    bad = [(a, b) for a, b in zip(mine, want) if a != b]
    if not bad:
        kinds = [(type(x), type(y)) for a, b in zip(mine, want) for x, y in zip(a, b) if x is not None]
        odd = {(k, j) for k, j in kinds if k is not j}
        return f"types differ {odd}" if odd else ""
    return f"{len(bad)} of {len(mine)} rows differ: {bad[:3]}"


def main(argv: list[str]) -> int:
    from tallyframe.plans import all_queries
    from tallyframe.session import local_session

    folder = f"/root/testdata/{argv[0]}"
    spark, con = local_session(), connect(folder)
    if os.environ.get("GROUP_ROWS"):  # force the oversized-group ways
        spark.conf.set("spark.tallyframe.groupRows", os.environ["GROUP_ROWS"])
    wrong = 0
    for name, (make, sql) in all_queries().items():
        if argv[1:] and name not in argv[1:] and make.__module__.split(".")[-1] not in argv[1:]:
            continue
        start = time.time()
        try:
            if sql:
                note = differences(spark, con, make, sql, folder)
            else:
                note = f"rows only: {len(make(spark, folder).collect())}"
        except Exception as err:
            note = f"{type(err).__name__}: {str(err)[:700]}"
        ok = not note or note.startswith("rows only")
        wrong += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("wrong:", wrong)
    return wrong


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
