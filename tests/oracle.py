"""Compares queries with their SQL: python -m tests.oracle [SCALE] [NAME...]; all without names."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return str(value) if value is not None else None


def differences(spark, folder: str, query, sql: str) -> str:
    """What differs between the query and its SQL, or ''."""
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = db.execute(sql)
    wanted_names = [x[0] for x in found.description]
    wanted = found.fetchall()
    df = query(spark, folder)
    if sorted(df.columns) != sorted(wanted_names):
        return f"columns {df.columns} and {wanted_names}"
    names = sorted(df.columns)
    got = Counter(tuple(plain(x) for x in row) for row in df.select(*names).collect())
    at = [wanted_names.index(n) for n in names]
    want = Counter(tuple(plain(row[i]) for i in at) for row in wanted)
    if got == want:
        return ""
    return f"{names}: {got.total()} and {want.total()} rows; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"


def main(args: list[str]) -> int:
    import __spark_entry__ as entry
    from corvane.session import get_session

    scale = args[0] if args and args[0][0].isdigit() else "0.01"
    names = [a for a in args if not a[0].isdigit()]
    spark = get_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            if name in oracle:
                said = differences(spark, f"{DATA}/sf{scale}", queries[name], oracle[name])
            else:
                said = "" if os.environ.get("ONLY_SQL") else f"{queries[name](spark, f'{DATA}/sf{scale}').count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.endswith("no SQL")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
