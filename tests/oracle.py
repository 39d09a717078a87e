"""Run queries next to their SQL and compare the rows.

As a program: ``python -m tests.oracle [sf_dir] [query ...]``.
"""

from __future__ import annotations

import sys
import time

import duckdb

from millrace.plans.registry import TABLES

SPARK_TO_SQL = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def mismatch(df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and a SQL result; None if nothing does."""
    relation = db.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    ours = {f.name: SPARK_TO_SQL[f.dataType.simpleString()] for f in df.schema.fields}
    if ours != theirs:
        return f"schema {ours} vs {theirs}"
    columns = sorted(ours)
    left = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    order = ", ".join(f'"{c}"' for c in columns)
    right = sorted(map(repr, db.sql(f"SELECT {order} FROM ({sql})").fetchall()))
    if left == right:
        return None
    extra = sorted(set(left) - set(right))[:3], sorted(set(right) - set(left))[:3]
    return f"{len(left)} vs {len(right)} rows; only ours {extra[0]}; only theirs {extra[1]}"


def main() -> None:
    import __spark_entry__ as entry
    from millrace.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.oracle_sql())
    spark = build_session(
        "oracle", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connection(sf_dir)
    for name in chosen:
        started = time.time()
        try:
            result = mismatch(entry.queries()[name](spark, sf_dir), db, entry.oracle_sql()[name])
        except Exception as error:  # noqa: BLE001  report and go on with the others
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:26s} {time.time() - started:6.2f}s {result or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
