"""Compare registered queries with their SQL twins: python tests/oracle_check.py [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(_cell(row[i]) for i in order)) for row in rows)


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
          "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, query, sql, sf_dir):
    """The number of rows when equal, else a text that says what differs."""
    df = query(spark, sf_dir)
    names = df.columns
    ours = [tuple(row) for row in df.collect()]
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(columns) != sorted(names):
        return f"columns {sorted(names)} / {sorted(columns)}"
    kinds = dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall())
    for name, kind in df.dtypes:
        if _KINDS.get(kind) != kinds[name]:
            return f"type of {name}: {kind} / {kinds[name]}"
    a, b = _rows(names, ours), _rows(columns, theirs)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return (f"{len(a)} / {len(b)} rows; only ours {len(only_a)}: {[x[:400] for x in only_a[:2]]}; "
                f"only theirs {len(only_b)}: {[x[:400] for x in only_b[:2]]}")
    return len(a)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from linkweave import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    failed = 0
    sqls = oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, query, sqls[name], sf_dir)
            else:
                problem = f"no sql; {query(spark, sf_dir).count()} rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += isinstance(problem, str)
        word = "FAIL" if isinstance(problem, str) else "ok  "
        print(f"{word} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
