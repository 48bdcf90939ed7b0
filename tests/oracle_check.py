"""Run the named queries beside their oracles and list differences.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from tests.session import spark_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def as_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(repr(row[i]) for i in order) for row in rows),
    )


def compare(spark, con, queries, name: str, sf_dir: str) -> str | None:
    """None if Spark and DuckDB give the same rows, else what differs."""
    table = queries[name](spark, sf_dir)
    got = as_rows(table.columns, table.collect())
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = as_rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(table.columns):
        return f"columns {sorted(table.columns)} != {sorted(columns)}"
    if got == want:
        return None
    extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return (
        f"{len(got)} rows, expected {len(want)}; {len(extra)} differ, "
        f"e.g. {extra[:2]} for {missing[:2]}"
    )


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries = contract.queries()
    names = sys.argv[2:] or list(contract.oracle_sql())
    spark = spark_session()
    con = connect(sf_dir)
    failed = 0
    for name in names:
        begin = time.time()
        try:
            difference = compare(spark, con, queries, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            difference = f"{type(error).__name__}: {str(error)[:600]}"
        failed += difference is not None
        print(f"{name}: {difference or 'ok'} ({time.time() - begin:.1f}s)", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
