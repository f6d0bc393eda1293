"""Run registered queries against their SQL oracle: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(repr(value)) + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: tuple(map(str, r))
    )


def compare(df, con, sql):
    """(row count, list of problems)."""
    spark_columns = df.columns
    spark_rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    problems = []
    if sorted(columns) != sorted(spark_columns):
        problems.append(f"columns {sorted(spark_columns)} <> {sorted(columns)}")
    if len(spark_rows) != len(expected):
        problems.append(f"rows {len(spark_rows)} <> {len(expected)}")
    if not problems:
        ours, theirs = rows_of(spark_columns, spark_rows), rows_of(columns, expected)
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        if bad:
            problems.append(f"{len(bad)} rows differ, first {bad[0][0]} <> {bad[0][1]}")
        kinds = {c: {type(plain(r[i])).__name__ for r in spark_rows} for i, c in enumerate(spark_columns)}
        want = {c: {type(plain(r[i])).__name__ for r in expected} for i, c in enumerate(columns)}
        for name in kinds:
            if kinds[name] != want[name]:
                problems.append(f"{name}: types {kinds[name]} <> {want[name]}")
            if kinds[name] >= {"int", "NoneType"} or kinds[name] >= {"bool", "NoneType"}:
                problems.append(f"{name}: nullable {kinds[name]}")
            if kinds[name] & {"list", "dict", "Row"}:
                problems.append(f"{name}: nested {kinds[name]}")
    return len(spark_rows), problems


def main() -> int:
    import __spark_entry__ as contract
    from tests.conftest import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session()
    con = connect(sf_dir)
    oracle = contract.oracle_sql()
    failed = 0
    wanted = sys.argv[2:]
    for name, build in contract.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                count, problems = compare(build(spark, sf_dir), con, oracle[name])
            else:
                count, problems = build(spark, sf_dir).count(), []
        except Exception as error:  # report and go on with the next query
            count, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        kind = "sql" if name in oracle else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name} [{kind}] rows={count} {time.time() - start:.2f}s", flush=True)
        for problem in problems:
            print("     ", problem[:1500], flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
